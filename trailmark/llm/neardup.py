"""Near-duplicate groups: fast similarity sketches, banding, exact verification.

A document's set holds its distinct shingles of ``k`` words (A-Z lower-cased,
words between ASCII white space), each as a 64-bit hash; a text of fewer words
is one shingle, a text without words has an empty set and no links. Two
documents are linked if 100 * |A and B| >= ``percent`` * |A or B|; a group is
what links connect, and its smallest doc_id names it.

* Sketch: ``SLOTS`` bins. Round i throws every shingle into a bin by a hash of
  its own and keeps in each bin the least (i, value); once no bin is empty the
  rounds end, and from round ``SLOTS`` on round i fills bin i - ``SLOTS``, so all
  bins fill. Equal places of two sketches estimate the similarity with
  concentration bounds.
* Bands: ``BANDS`` runs of four bins. Two sets of similarity 0.8 share none with
  probability (1 - 0.8 ** 4) ** 24 < 4e-6.
* Verification: documents with equal sets are one node. In each bucket of equal
  bands the smallest node is the pivot, and all others are compared with it, on
  whole sets taken from the texts again. What is linked to the pivot needs no
  further look among itself. A member at a distance d > 1 - s from its pivot
  can only be linked to members whose distance from the same pivot differs from
  d by 1 - s at most (Jaccard distance is a metric); of such pairs, unless
  already connected, those whose longer sketches are not clearly too unlike
  are compared as well. So no link between different
  components is lost, and a group of n copies costs n comparisons.
* Components: smallest labels spread along links, with pointer jumping.

Defined cases: equal sets without any known id are linked with nothing and
have a null component, which counts as their own; an id with several texts is
one document, whose links are united; repeated rows are copies of each other;
extra columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.llm.shared import give_back, small_batches, written

SLOTS, BANDS, ROWS = 96, 24, 4
#: Places of the longer sketch that sorts out pairs of a bucket before they are compared.
MARKS = 2048
#: Nodes to verify that are broadcast to the scan of the texts; more are joined by shuffle.
FEW = 200_000
#: Members that one pivot's copy of its set serves, and those of a bucket's part.
CHUNK = 256
#: Word hashes that a Python worker keeps.
KEPT_WORDS = 50_000

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits all depend on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_words = _Words()


def shingles(text: str | None, k: int) -> np.ndarray:
    """The sorted hashes of a text's distinct shingles."""
    # bytes.lower() and bytes.split() know ASCII letters and ASCII white space only
    words = (text or "").encode().lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, n)
    m = min(k, n)
    out = np.full(n - m + 1, m, np.uint64)
    for i in range(m):
        out = mixed(out * _STEP + h[i : n - m + 1 + i])
    return np.unique(out)


def sketch(items: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """``slots`` numbers; equal ones in the same place are as likely as the sets are similar."""
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    bins = np.full(slots, full)
    for i in range(2 * slots):
        h = mixed(items + np.uint64(i + 1) * _STEP)
        where = (h >> np.uint64(32)) * np.uint64(slots) >> np.uint64(32) if i < slots else np.full(len(items), i - slots, np.uint64)
        value = np.uint64(i) << np.uint64(48) | mixed(h) >> np.uint64(16)
        np.minimum.at(bins, where.astype(np.intp), value)
        if (bins != full).all():
            break
    return bins


def bands(items: np.ndarray) -> np.ndarray:
    """A number for each band of the sketch; different bands share none but by accident."""
    bins = sketch(items).reshape(BANDS, ROWS)
    out = np.arange(1, BANDS + 1, dtype=np.uint64) * _M2
    for r in range(ROWS):
        out = mixed(out * _STEP + bins[:, r])
    return out


def marks(items: np.ndarray) -> np.ndarray:
    """A bit of each place of a sketch of ``MARKS`` places, packed into longs."""
    bits = (mixed(sketch(items, MARKS)) & np.uint64(1)).astype(np.uint8)
    return np.packbits(bits).view(np.int64)


def least_agreement(percent: int) -> int:
    """Equal marks that a linked pair has, but for a chance of 3e-7: the mean less five deviations."""
    equal = (1 + percent / 100) / 2
    return int(MARKS * (equal - 5 * (equal * (1 - equal) / MARKS) ** 0.5))


def print_of(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _sketched(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    with np.errstate(over="ignore"):
        for batch in batches:
            n, low, high, keys = [], [], [], []
            for text in batch.column("text"):
                items = shingles(text.as_py(), k)
                n.append(len(items))
                print_ = xxhash.xxh3_128_intdigest(items.tobytes())
                low.append((print_ & (1 << 64) - 1) - (1 << 63))
                high.append((print_ >> 64) - (1 << 63))
                keys.append(bands(items).view(np.int64) if len(items) else np.empty(0, np.int64))
            offsets = np.cumsum([0, *map(len, keys)], dtype=np.int32)
            values = np.concatenate(keys) if keys else np.empty(0, np.int64)
            arrays = [batch.column("doc_id"), batch.column("print"), pa.array(n, pa.int64()), pa.array(low, pa.int64()), pa.array(high, pa.int64()), pa.ListArray.from_arrays(offsets, values)]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "print", "n", "lo", "hi", "bands"])
    _words.clear()  # a worker outlives the task
    give_back()


def sketches(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, ``print`` (hash of the text), ``n`` (size of the set), ``lo`` and ``hi`` (hash of the set), ``bands``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), print_of(F.col("text")).alias("print"), "text")
    return rows.mapInArrow(lambda it: _sketched(it, k), "doc_id long, print long, n long, lo long, hi long, bands array<long>")


def _compared(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows come by pivot and chunk, the pivot's own row first."""
    at, pivot = None, np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        for batch in batches:
            out = []
            for *key, member, text in zip(*(batch.column(c) for c in ("pivot", "pprint", "chunk", "member", "text")), strict=True):
                key, m = [x.as_py() for x in key], member.as_py()
                items = shingles(text.as_py(), k)
                if m is None:
                    at, pivot = key, items
                    continue
                if at != key:
                    raise ValueError(f"no set for pivot {key}")
                both = len(np.intersect1d(items, pivot, assume_unique=True))
                out.append((key[0], key[1], m, both, len(items) + len(pivot) - both))
            columns = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["pivot", "pprint", "member", "both", "any"])
    _words.clear()
    give_back()


def compared(pairs: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """Sizes of intersection and union of each pair (pivot, member) of doc_ids.

    ``pprint`` and ``mprint`` say which text, should an id have several. A
    pivot's text goes once to each ``CHUNK`` of its members, so that a hot
    pivot is many tasks' work.
    """
    spark = pairs.sparkSession
    counts = pairs.groupBy("pivot", "pprint").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    pairs = pairs.join(counts, ["pivot", "pprint"]).select("pivot", "pprint", "member", "mprint", F.pmod(F.xxhash64("member"), F.col("chunks")).cast("int").alias("chunk"))
    pairs = written(pairs, "pairs")
    none = F.lit(None).cast("long").alias("member")
    heads = pairs.select("pivot", "pprint", "chunk").distinct().select("pivot", "pprint", "chunk", none, F.col("pivot").alias("doc_id"), F.col("pprint").alias("print"))
    wanted = heads.unionByName(pairs.select("pivot", "pprint", "chunk", "member", F.col("member").alias("doc_id"), F.col("mprint").alias("print")))
    if pairs.count() <= FEW:
        wanted = F.broadcast(wanted)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), print_of(F.col("text")).alias("print"), "text")
    rows = texts.join(wanted, ["doc_id", "print"]).select("pivot", "pprint", "chunk", "member", "text")
    rows = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "pivot", "pprint", "chunk")
    rows = rows.sortWithinPartitions("pivot", "pprint", "chunk", F.col("member").asc_nulls_first())
    return rows.mapInArrow(lambda it: _compared(it, k), "pivot long, pprint long, member long, both long, any long").distinct()


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``label`` (the smallest node it is connected with) of every node of ``links`` (a, b).

    Each round: labels of all neighbours, then the label's own label. Ends when
    nothing changes; rounds grow with the logarithm of a group's diameter.
    """
    edges = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = edges.join(labels.select(F.col("node").alias("b"), F.col("label").alias("seen")), "b").groupBy(F.col("a").alias("node")).agg(F.min("seen").alias("seen"))
        hooked = labels.join(near, "node").select("node", "label", F.least("label", "seen").alias("new"))
        # also hang the old label below the new one, so that whole trees move at once
        roots = hooked.where("new < label").groupBy(F.col("label").alias("node")).agg(F.min("new").alias("root"))
        hooked = hooked.join(roots, "node", "left").select("node", "label", F.least("new", F.coalesce("root", "new")).alias("new"))
        up = hooked.select(F.col("node").alias("new"), F.col("new").alias("top"))
        jumped = written(hooked.join(up, "new").select("node", "label", F.least("new", "top").alias("new")), "labels")
        changed = jumped.where("new < label").limit(1).count()
        labels = jumped.select("node", F.col("new").alias("label"))
        if not changed:
            return labels


def groups(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, lo and hi (hash of the set) and print (hash of the text) of every row of ``docs``."""
    small_batches(docs.sparkSession)
    rows = written(sketches(docs, k), "sketches")
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "print"))).alias("first")
    sets = rows.where("n > 0").groupBy("lo", "hi").agg(first, F.first("n").alias("n"), F.first("bands").alias("bands"))
    nodes = written(sets.where("first is not null").select("lo", "hi", F.col("first.doc_id").alias("node"), F.col("first.print").alias("print"), "n", "bands"), "nodes")
    keys = nodes.select("node", "print", "n", F.explode("bands").alias("key"))
    tops = keys.groupBy("key").agg(F.min(F.struct("node", "print", "n")).alias("top"), F.count("*").alias("c")).where("c > 1")
    members = keys.join(tops, "key").select("key", F.col("top.node").alias("pivot"), F.col("top.print").alias("pprint"), F.col("top.n").alias("pn"), F.col("node").alias("member"), F.col("print").alias("mprint"), "n")
    members = written(members.where("pivot != member"), "members")
    fits = F.least("pn", "n") * 100 >= F.greatest("pn", "n") * percent
    done = written(compared(members.where(fits).select("pivot", "pprint", "member", "mprint").distinct(), docs, k), "compared")
    linked = F.col("both") * 100 >= F.col("any") * percent
    links = done.where(linked).select(F.col("pivot").alias("a"), F.col("member").alias("b"))
    # an id with several texts is one document
    ids = rows.where("n > 0").select("lo", "hi", "doc_id").join(nodes.select("lo", "hi", "node"), ["lo", "hi"]).where("doc_id != node")
    many = ids.select(F.col("node").alias("a"), F.col("doc_id").alias("b")).join(nodes.select(F.col("node").alias("b")), "b", "left_semi").select("a", "b")
    links = written(links.unionByName(many), "links")
    labels = components(links)
    rest = written(_rest(members, done, labels, nodes, docs, k, percent), "rest")
    if rest.limit(1).count():
        more = compared(rest, docs, k).where(linked)
        labels = components(links.unionByName(more.select(F.col("pivot").alias("a"), F.col("member").alias("b"))))
    named = nodes.select("lo", "hi", "node").join(labels, "node", "left").select("lo", "hi", F.coalesce("label", "node").alias("component_id"))
    out = rows.select("doc_id", "print", "n", "lo", "hi").join(named, ["lo", "hi"], "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "lo", "hi", "print")


def _marked(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    with np.errstate(over="ignore"):
        for batch in batches:
            out = [marks(shingles(t.as_py(), k)).tolist() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("member"), batch.column("mprint"), pa.array(out, pa.list_(pa.int64()))], ["member", "mprint", "marks"])
    _words.clear()
    give_back()


def _rest(members: DataFrame, done: DataFrame, labels: DataFrame, nodes: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs of a bucket's members that are not yet connected and may be linked.

    ``low`` and ``high`` bound a member's distance from the pivot: both are
    that distance where the pair was compared; a member whose size alone rules
    out a link has the least distance that its size allows, and one. At least
    one of a pair is not linked to the pivot: else they are connected already.
    Of the pairs that these bounds leave, longer sketches rule out those that
    are clearly less similar; a pair comes from the first bucket it shares only.
    """
    far = (100 - percent) / 100 + 1e-9
    known = done.select("pivot", "pprint", "member", (1 - F.col("both") / F.col("any")).alias("t"))
    by_size = 1 - F.least("pn", "n") / F.greatest("pn", "n")
    m = members.join(known, ["pivot", "pprint", "member"], "left")
    m = m.select("key", "member", "mprint", "n", F.coalesce("t", by_size).alias("low"), F.coalesce("t", F.lit(1.0)).alias("high"))
    m = m.join(labels.withColumnRenamed("node", "member"), "member", "left").withColumn("label", F.coalesce("label", "member"))
    m = written(m.dropDuplicates(["key", "member", "mprint"]), "distances")
    # buckets in which a pair is open at all; a large one is cut into parts, each of which meets its open members
    busy = m.groupBy("key").agg(F.max("high").alias("top"), F.min("label").alias("a"), F.max("label").alias("b"), F.ceil(F.count("*") / CHUNK).cast("int").alias("parts"))
    busy = busy.where((F.col("top") > far) & (F.col("a") != F.col("b"))).select("key", "parts")
    m = written(m.join(busy, "key"), "busy")
    who = m.select("member", "mprint").distinct()
    if who.count() <= FEW:
        who = F.broadcast(who)
    texts = docs.select(F.col("doc_id").cast("long").alias("member"), print_of(F.col("text")).alias("mprint"), "text").join(who, ["member", "mprint"])
    more = texts.mapInArrow(lambda it: _marked(it, k), "member long, mprint long, marks array<long>").dropDuplicates(["member", "mprint"])
    more = more.join(nodes.select(F.col("node").alias("member"), F.col("print").alias("mprint"), "bands"), ["member", "mprint"])
    m = m.join(written(more, "marks"), ["member", "mprint"])
    part = F.pmod(F.xxhash64("member"), F.col("parts")).cast("int")
    open_ = m.where(F.col("high") > far).withColumn("part2", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    open_ = open_.select(F.col("key").alias("key2"), "part2", *(F.col(c).alias(f"{c}2") for c in ("member", "mprint", "n", "low", "high", "label", "marks", "bands")))
    apart = (F.col("label") != F.col("label2")) & ((F.col("high") <= far) | (F.col("member") < F.col("member2")))
    near = (F.col("low") - F.col("high2") <= far) & (F.col("low2") - F.col("high") <= far) & (F.least("n", "n2") * 100 >= F.greatest("n", "n2") * percent)
    unlike = F.lit(0)
    for i in range(MARKS // 64):
        unlike = unlike + F.bit_count(F.get("marks", F.lit(i)).bitwiseXOR(F.get("marks2", F.lit(i))))
    alike = unlike <= MARKS - least_agreement(percent)
    first = F.array_min(F.array_intersect("bands", "bands2")) == F.col("key")
    one, two = F.struct(F.col("member").alias("id"), F.col("mprint").alias("print")), F.struct(F.col("member2").alias("id"), F.col("mprint2").alias("print"))
    pair = m.withColumn("part", part).join(open_, (F.col("key") == F.col("key2")) & (F.col("part") == F.col("part2")) & apart & near & alike & first).select(F.least(one, two).alias("p"), F.greatest(one, two).alias("m"))
    return pair.select(F.col("p.id").alias("pivot"), F.col("p.print").alias("pprint"), F.col("m.id").alias("member"), F.col("m.print").alias("mprint")).distinct()


def identified(docs: DataFrame) -> tuple[DataFrame, Column]:
    """``record`` (the row), ``doc_id`` and ``text`` of each row of ``docs``, and whether a doc_id is a known one.

    Rows without an id get one of their text, in the wider room above or below the known ids.
    """
    id_ = F.col("record.doc_id").cast("long")
    rows = docs.select(F.struct("*").alias("record"))
    r = rows.agg(F.min(id_).alias("low"), F.max(id_).alias("high")).first()
    low, high = (0, -1) if r.low is None else (r.low, r.high)
    above, below = 2**63 - 1 - high, low + 2**63
    room = max(1, min(2**63 - 1, max(above, below)))
    offset = F.pmod(print_of(F.col("record.text")), F.lit(room))
    own = offset + F.lit(high + 1) if above >= below else F.lit(low - 1) - offset
    known = F.lit(False) if r.low is None else F.col("doc_id").between(low, high)
    return rows.select("record", F.coalesce(id_, own).alias("doc_id"), F.col("record.text").alias("text")), known


def deduplicated(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row of ``docs`` for each group, with the columns of ``docs``.

    It has the group's least known doc_id, if there is one. Rows without an
    id are in the groups of their texts; those without words as well are copies if their texts are equal.
    """
    rows, known = identified(docs)
    found = groups(rows.select("doc_id", "text"), k, percent)
    # equal rows are counted first, so that a hot one is one row of each task
    each = found.groupBy("component_id", (F.col("n_shingles") == 0).alias("blank"), (~known).alias("unknown"), "doc_id", "print").agg(F.count("*").alias("c"))
    best = each.groupBy("component_id").agg(F.min(F.struct("blank", "unknown", "doc_id", "print", "c")).alias("top"))
    best = written(best.select(F.col("top.doc_id").alias("doc_id"), F.col("top.print").alias("print"), F.col("top.c").alias("c")), "best")
    rows = rows.select("record", "doc_id", print_of(F.col("text")).alias("print"))
    single = rows.join(best.where("c = 1"), ["doc_id", "print"], "left_semi").select("record.*")
    again = rows.join(best.where("c > 1"), ["doc_id", "print"], "left_semi").groupBy("doc_id", "print").agg(F.first("record").alias("record")).select("record.*")
    return single.unionByName(again)
