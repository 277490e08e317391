"""N-gram Jaccard self-join with set-relation skipping; exact, by components.

Sets of word shingles (64-bit hashes) are joined where 100 * intersection >= 90 * union.

1. Equal sets (by size and 128 bits from two independent hash passes) are one class; its smallest
   document stands for it, and copies never form pairs.
2. Shingles are ordered rarest first by a sketch of their counts over all texts (fixed size; any
   order is exact, this one keeps common passages out of prefixes). The shortest prefix of a set
   that must meet any partner's is indexed: an index list per shingle of (position, size, set).
3. Answers from similar sets: in each list the set whose prefix others share most is compared with
   all, and the exact differences are kept. Verified links give components, and whoever is in the
   same component is skipped later. For two others y and z of the list the difference is derived from
   that set t's answers: |y - z| is at least ||t - y| - |t - z||, which skips pairs unseen.
4. The rest of each long list is cut into blocks by size, position and component. A table of blocks
   (smallest and largest size, most that can follow a position, components) is joined with itself,
   and only the block pairs that can hold a link are dealt to tasks: blocks too far apart in size,
   too late in their prefixes to reach the overlap, or of one component are skipped whole. Within a
   block pair the same bounds skip members, and parities of shingles over 1024 cells bound the
   difference of two sets from below.
5. What is left is verified on the texts' full shingle sets, the set with more partners standing
   beside up to 64 of them at a time, and components are closed.

Nothing is capped or sampled: lists of any length are covered by block pairs.

Defined cases: null and empty texts, or texts without words, have no shingles and no links; a text
of fewer words than a shingle is one shingle; null ids get the component of their class's smallest
id, null if it has none; rows that repeat an id share what the id has; an empty table gives no rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, staged
from .components import components, popcounts
from .textbytes import blocks, mixed, shingles

WIDTH, PERCENT = 3, 90
#: Counters of the sketch, sections it is merged in, arrays merged at once, cells of the parity vectors, members of a block.
SKETCH_BITS, SECTIONS, MERGE, CELLS, BLOCK = 22, 64, 256, 1024, 512
#: Bits of the table of ids in pairs, by the number of ids: at least, at most (32 MB).
FILTER_BITS = (23, 28)
#: Partners of a set that one copy of its text is compared with.
PARTNERS = 64
#: Lists up to this size give pairs at once, compared by parity after repeats are gone; longer ones compare parities in place.
SHORT = 32


def row_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of uint64 values by row, modulo 2^64."""
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)))
    return total[offsets[1:]] - total[offsets[:-1]]


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def digests(docs: DataFrame, width: int) -> DataFrame:
    """A row per text (id, n, d1, d2: size and 128-bit digest of its set) and rows (section, part, data) of the sketch."""
    schema = "id long, n long, d1 long, d2 long, section int, part int, data binary"

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in schema.split(", ")]
        sketch, any_ = np.zeros(1 << SKETCH_BITS, np.uint32), False
        for batch in parts:
            for b in blocks(batch, "text", 1 << 18):
                h, second, at = shingles(b.column("text"), width)
                any_ = True
                np.add.at(sketch, (h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), 1)
                d1, d2 = row_sums(mixed(h), at), row_sums(mixed(second), at)
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(np.diff(at)), signed(d1), signed(d2), *(pa.nulls(b.num_rows, t) for t in (pa.int32(), pa.int32(), pa.binary()))], names)
        if any_:
            counts = [zlib.compress(x.tobytes(), 1) for x in np.split(sketch.astype(np.uint64), SECTIONS)]
            nulls = [pa.nulls(SECTIONS, pa.int64())] * 4
            yield pa.RecordBatch.from_arrays([*nulls, pa.array(range(SECTIONS), pa.int32()), pa.array([TaskContext.get().partitionId()] * SECTIONS, pa.int32()), pa.array(counts, pa.binary())], names)

    return docs.mapInArrow(run, schema)


def merged(rows: DataFrame, parts: int, kind: type, join: np.ufunc) -> np.ndarray:
    """The arrays of rows (section, part, data) joined by section, MERGE of them at a time, and put in a row.

    parts: a bound on part. However many tasks have contributed, no task holds more than MERGE arrays.
    """

    def merge(key: tuple[int, int], frame: pd.DataFrame) -> pd.DataFrame:
        total = None
        for x in frame["data"]:
            own = np.frombuffer(zlib.decompress(x), kind)
            total = own.copy() if total is None else join(total, own, out=total)
        return pd.DataFrame({"section": [key[0]], "part": [key[1]], "data": [zlib.compress(total.tobytes(), 1)]})

    while True:
        rows = rows.select("section", F.floor(F.col("part") / MERGE).cast("int").alias("part"), "data")
        rows, parts = rows.groupBy("section", "part").applyInPandas(merge, "section int, part int, data binary"), -(-parts // MERGE)
        if parts <= 1:
            found = {r.section: np.frombuffer(zlib.decompress(r.data), kind) for r in rows.collect()}  # SECTIONS rows
            size = max(map(len, found.values()), default=0)
            return np.concatenate([found.get(k, np.zeros(size, kind)) for k in range(SECTIONS)])
        rows = staged(rows, "ngram-merge")


def sketch_of(rows: DataFrame) -> np.ndarray:
    """The merged sketch as 8-bit logarithms: 2^22 bytes, whatever the corpus."""
    parts = rows.agg(F.max("part")).first()[0]
    if parts is None:
        return np.zeros(1 << SKETCH_BITS, np.uint8)
    total = merged(rows, parts + 1, np.uint64, np.add)
    return np.minimum(255, np.floor(8 * np.log2(total.astype(np.float32) + 1))).astype(np.uint8)


def prefixes(docs: DataFrame, sketch: np.ndarray, width: int, percent: int) -> DataFrame:
    """(id, n, d1, d2, prefix, parity) of each text with shingles; prefix is ordered rarest first."""
    shared = docs.sparkSession.sparkContext.broadcast(sketch)
    schema = "id long, n long, d1 long, d2 long, prefix array<long>, parity binary"

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rare = shared.value
        for batch in parts:
            for b in blocks(batch, "text", 1 << 18):
                h, second, at = shingles(b.column("text"), width)
                n = np.diff(at)
                row = np.repeat(np.arange(len(n)), n)
                d1, d2 = row_sums(mixed(h), at), row_sums(mixed(second), at)
                cell = (mixed(h + np.uint64(77)) >> np.uint64(54)).astype(np.int64)
                odd = np.zeros(len(n) * CELLS, np.uint8)
                np.add.at(odd, row * CELLS + cell, 1)  # modulo 256, which keeps parity
                parity = np.packbits((odd & 1).reshape(len(n), CELLS), axis=1)
                order = np.lexsort((h, rare[(h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)], row))
                place = np.arange(len(h)) - at[row]
                take = place < (n - (percent * n + 99) // 100 + 1)[row]
                kept = h[order][take]
                ends = np.concatenate(([0], np.cumsum(np.bincount(row[take], minlength=len(n)))))
                full = pa.array(n > 0)
                out = [b.column("id"), pa.array(n), signed(d1), signed(d2), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), signed(kept)), pa.array([p.tobytes() for p in parity], pa.binary())]
                yield pa.RecordBatch.from_arrays([x.filter(full) for x in out], [x.split()[0] for x in schema.split(", ")])

    return docs.mapInArrow(run, schema)


def possible(n1: np.ndarray, at1: np.ndarray, diff1: np.ndarray, parity1: np.ndarray, n2: np.ndarray, at2: np.ndarray, diff2: np.ndarray, parity2: np.ndarray, percent: int) -> np.ndarray:
    """Whether two sets that first meet at these places can link: by size, position, differences to a third set (-1: unknown), and parity."""
    both = n1 + n2
    least = -(-percent * both // (100 + percent))  # the smallest overlap o with 100 o >= percent (both - o)
    ok = (100 * np.minimum(n1, n2) >= percent * np.maximum(n1, n2)) & (np.minimum(n1 - at1, n2 - at2) >= least)
    ok &= (diff1 < 0) | (diff2 < 0) | (np.abs(diff1 - diff2) <= both - 2 * least)
    out = np.zeros(len(ok), bool)
    i = np.flatnonzero(ok)
    out[i] = popcounts(parity1[i] ^ parity2[i]) <= both[i] - 2 * least[i]
    return out


def parities(column: pa.Array) -> np.ndarray:
    data = np.frombuffer(b"".join(column.to_pylist()), np.uint64)
    return data.reshape(-1, CELLS // 64)


def tops_of(lists: DataFrame) -> DataFrame:
    """(token, id0, n0, at0): each list's set whose prefix others share most."""
    top = lists.groupBy("token").agg(F.max(F.struct("common", (-F.col("id")).alias("minus"), "n", "at")).alias("t"))
    return top.select("token", (-F.col("t.minus")).alias("id0"), F.col("t.n").alias("n0"), F.col("t.at").alias("at0"))


def with_first(lists: DataFrame, tops: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs (a, b) of each list's top set with the others, by size and position."""
    both = lists.join(tops, "token").filter("id <> id0")
    sized = (100 * F.least("n", "n0") >= percent * F.greatest("n", "n0")) & ((100 + percent) * F.least(F.col("n") - F.col("at"), F.col("n0") - F.col("at0")) >= percent * (F.col("n") + F.col("n0")))
    return both.filter(sized).select(F.least("id", "id0").alias("a"), F.greatest("id", "id0").alias("b")).distinct()


def close_parities(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose parity vectors leave them possible."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            if b.num_rows:
                both = b.column("na").to_numpy() + b.column("nb").to_numpy()
                least = -(-percent * both // (100 + percent))
                ok = popcounts(parities(b.column("pa")) ^ parities(b.column("pb"))) <= both - 2 * least
                yield pa.RecordBatch.from_arrays([x.filter(pa.array(ok)) for x in (b.column("a"), b.column("b"))], ["a", "b"])

    of = lambda k: sets.select(F.col("id").alias(k), F.col("n").alias(f"n{k}"), F.col("parity").alias(f"p{k}"))
    return pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "na", "nb", "pa", "pb").mapInArrow(run, "a long, b long").distinct()


def block_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """lists with a row per pair of blocks (pair, left, right) that a member is in; block tells the two apart.

    Members of a list are grouped by component (those of BLOCK members or more; the others together), size class
    and quarter of the prefix; a group is split into blocks by a hash. Pairs of groups that can't hold a link are left out.
    """
    # stored, so that its join reads plain exchanges and the partition of a large component can be split
    big = staged(lists.groupBy("token", "comp").agg(F.count("*").alias("k")).filter(F.col("k") >= BLOCK).select("token", "comp", F.col("comp").alias("own")), "ngram-big")
    width = F.col("n") - F.floor((percent * F.col("n") + 99) / 100) + 1
    kind = F.floor(F.log(F.col("n").cast("double")) / math.log(100 / percent)).cast("int") if percent < 100 else F.col("n").cast("int")
    members = lists.join(big, ["token", "comp"], "left").withColumn("group", F.xxhash64(F.col("own").isNull(), "own", kind, F.floor(4 * F.col("at") / width)))
    groups = members.groupBy("token", "group").agg(
        F.ceil(F.count("*") / BLOCK).cast("int").alias("cuts"), F.min("n").alias("lo"), F.max("n").alias("hi"), F.max(F.col("n") - F.col("at")).alias("far"), F.min("comp").alias("c1"), F.max("comp").alias("c2")
    )
    groups = staged(groups, "ngram-blocks")
    x, y = (groups.select("token", *[F.col(c).alias(c + k) for c in groups.columns if c != "token"]) for k in "xy")
    met = x.join(y, "token").filter("groupx <= groupy and not (c1x = c2x and c1y = c2y and c1x = c1y)")
    met = met.filter((100 * F.col("hix") >= percent * F.col("loy")) & (100 * F.col("hiy") >= percent * F.col("lox")))
    met = met.filter((100 + percent) * F.least("farx", "fary") >= percent * (F.col("lox") + F.col("loy"))).withColumn("pair", F.xxhash64("groupx", "groupy"))
    same = F.col("groupx") == F.col("groupy")
    sides = met.select("token", "pair", F.col("groupx").alias("group"), same.alias("same"), F.lit(0).alias("side"), F.col("cutsx").alias("cuts"), F.col("cutsy").alias("others"))
    sides = sides.union(met.filter(~same).select("token", "pair", F.col("groupy"), F.lit(False), F.lit(1), F.col("cutsy"), F.col("cutsx")))
    dealt = members.drop("own").join(sides, ["token", "group"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("cuts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("others") - 1)))
    left = F.when(F.col("same"), F.least("block", "other")).when(F.col("side") == 0, F.col("block")).otherwise(F.col("other"))
    right = F.when(F.col("same"), F.greatest("block", "other")).when(F.col("side") == 0, F.col("other")).otherwise(F.col("block"))
    # in a pair of two groups block is the side; in a group with itself, the block's number where the two differ
    return dealt.select("token", "pair", left.alias("left"), right.alias("right"), F.when(~F.col("same"), F.col("side")).when(F.col("block") == F.col("other"), -1).otherwise(F.col("block")).alias("block"), "id", "n", "at", "diff", "comp", *["parity"] * ("parity" in lists.columns))


def between_components(dealt: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs (a, b) of different components among the members of a pair of blocks (pair, left, right)."""
    with_parity = "parity" in dealt.columns
    keys = ("token", "pair", "left", "right")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in parts:
            if not batch.num_rows:
                continue
            held.append(batch)
            table = pa.Table.from_batches(held).combine_chunks()
            key = [table.column(k).to_numpy() for k in keys]
            edge = np.flatnonzero(np.any([k[1:] != k[:-1] for k in key], axis=0)) + 1
            if len(edge):  # groups that have ended
                yield from groups(table.slice(0, edge[-1]), edge)
                held = table.slice(edge[-1]).to_batches()
        if held:
            table = pa.Table.from_batches(held).combine_chunks()
            yield from groups(table, np.array([table.num_rows]))

    def groups(table: pa.Table, ends: np.ndarray) -> Iterator[pa.RecordBatch]:
        n, at, diff, id_, comp, block = (table.column(k).to_numpy() for k in ("n", "at", "diff", "id", "comp", "block"))
        parity = parities(table.column("parity")) if with_parity else np.zeros((len(n), 1), np.uint64)
        begin = 0
        a_out: list[np.ndarray] = []
        b_out: list[np.ndarray] = []
        for end in ends.tolist():
            own = np.arange(begin, end)
            own = own[np.argsort(n[own], kind="stable")]
            # partners have sizes from n to 100 n / percent: a run of the sorted list, the rest is skipped
            stop = np.searchsorted(n[own], (100 * n[own]) // percent, side="right")
            for i in range(len(own) - 1):
                x, y = own[i], own[i + 1 : stop[i]]
                y = y[(comp[y] != comp[x]) & ((block[y] != block[x]) | (block[x] < 0))]
                if len(y):
                    full = lambda v, m=len(y): np.broadcast_to(v, (m, *np.shape(v)))
                    y = y[possible(full(n[x]), full(at[x]), full(diff[x]), full(parity[x]), n[y], at[y], diff[y], parity[y], percent)]
                    a_out.append(np.full(len(y), id_[x]))
                    b_out.append(id_[y])
            begin = end
        if a_out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a_out)), pa.array(np.concatenate(b_out))], ["a", "b"])

    dealt = dealt.repartition(*keys).sortWithinPartitions(*keys, "id")
    pairs = dealt.mapInArrow(run, "a long, b long")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def bits_of(ids: DataFrame, bits: int) -> np.ndarray:
    """A table of 2^bits bits with those set that the ids hash to."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << (bits - 3), np.uint8)
        for batch in parts:
            at = places(batch.column("id").to_numpy(), bits)
            np.bitwise_or.at(table, at >> 3, np.uint8(128) >> (at & 7).astype(np.uint8))
        out = [(k, zlib.compress(x.tobytes(), 1)) for k, x in enumerate(np.split(table, SECTIONS)) if x.any()]
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int32()), pa.array([part] * len(out), pa.int32()), pa.array([x for _, x in out], pa.binary())], ["section", "part", "data"])

    rows = staged(ids.select("id").mapInArrow(run, "section int, part int, data binary"), "ngram-bits")
    parts = rows.agg(F.max("part")).first()[0]
    return merged(rows, parts + 1, np.uint8, np.bitwise_or) if parts is not None else np.zeros(1 << (bits - 3), np.uint8)


def places(ids: np.ndarray, bits: int) -> np.ndarray:
    return (mixed(ids.astype(np.int64).view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)


def texts_of(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """(id, text) of the documents in ids, stored. A bit table keeps most others' texts out of the shuffle; the join is exact."""
    bits = min(FILTER_BITS[1], max(FILTER_BITS[0], (8 * ids.count()).bit_length()))
    shared = docs.sparkSession.sparkContext.broadcast(bits_of(ids, bits))

    @F.pandas_udf("boolean")
    def maybe(id_: pd.Series) -> pd.Series:
        at = places(id_.to_numpy(), bits)
        return pd.Series((shared.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).astype(bool)

    return staged(docs.filter("id is not null").filter(maybe("id")).join(ids, "id", "left_semi").select("id", "text"), "ngram-texts")


def verified(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(a, b, diff, link) of pairs (a, b), stored: the size of the sets' difference, and whether they link.

    Of a pair the set with more partners is the hub; its text is sent once for PARTNERS of them.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, p, p2 = None, None, None
        for batch in parts:
            for b in blocks(batch, "text", 1 << 18):
                h, second, at = shingles(b.column("text"), width)
                out: list[tuple[int, int, int, bool]] = []
                for i, (own, other) in enumerate(zip(b.column("hub").to_pylist(), b.column("other").to_pylist(), strict=True)):
                    q, q2 = h[at[i] : at[i + 1]], second[at[i] : at[i + 1]]
                    if other is None:
                        hub, p, p2 = own, q.copy(), q2.copy()
                        continue
                    assert hub == own
                    k = np.minimum(np.searchsorted(p, q), max(0, len(p) - 1))
                    o = int(((p[k] == q) & (p2[k] == q2)).sum()) if len(p) else 0
                    out.append((min(own, other), max(own, other), len(p) + len(q) - 2 * o, o > 0 and 100 * o >= percent * (len(p) + len(q) - o)))
                cols = zip(*out, strict=True) if out else [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.bool_()), strict=True)], ["a", "b", "diff", "link"])

    ids = staged(pairs.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("k")), "ngram-ids")
    texts = texts_of(ids, docs)
    of = lambda c: ids.select(F.col("id").alias(c), F.col("k").alias("k" + c))
    first = F.col("ka") >= F.col("kb")
    turned = pairs.join(of("a"), "a").join(of("b"), "b").select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("hub"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("other"), F.greatest("ka", "kb").alias("k"))
    turned = staged(turned.select("hub", F.pmod(F.xxhash64("other"), F.ceil(F.col("k") / PARTNERS)).cast("int").alias("part"), "other"), "ngram-turned")
    hubs = turned.select("hub", "part").distinct().join(texts.withColumnRenamed("id", "hub"), "hub").select("hub", "part", F.lit(None).cast("long").alias("other"), "text")
    others = turned.join(texts.withColumnRenamed("id", "other"), "other").select("hub", "part", "other", "text")
    beside = hubs.union(others).repartition("hub", "part").sortWithinPartitions("hub", "part", F.col("other").asc_nulls_first())
    return staged(beside.select("hub", "other", "text").mapInArrow(run, "a long, b long, diff long, link boolean"), "ngram-verified")


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of docs."""
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    seen = staged(digests(docs, width), "ngram-digests")
    rows = seen.filter("section is null").select("id", "n", "d1", "d2")
    classes = staged(rows.filter("n > 0").groupBy("n", "d1", "d2").agg(F.min("id").alias("rep"), F.count("*").alias("rows")), "ngram-classes")
    reps = classes.filter("rep is not null").select(F.col("rep").alias("id"), "n", "d1", "d2")
    indexed = prefixes(docs.filter("id is not null"), sketch_of(seen.filter("section is not null")), width, percent)
    indexed = staged(indexed.join(reps, ["id", "n", "d1", "d2"], "left_semi").select("id", "n", "prefix", "parity"), "ngram-prefixes")
    token = indexed.select("id", "n", F.posexplode("prefix").alias("at", "token"))
    # counted in the map tasks first and joined back: the join's partition of a frequent token can be split
    sizes = staged(token.groupBy("token").agg(F.count("*").alias("size")).filter("size > 1"), "ngram-sizes")
    lists = staged(token.join(sizes, "token"), "ngram-lists")
    share = F.count("*") / (F.max("n") - F.floor((percent * F.max("n") + 99) / 100) + 1)  # of its prefix
    lists = staged(lists.join(lists.groupBy("id").agg(share.alias("common")), "id"), "ngram-members")
    sets = indexed.select("id", "n", "parity")
    tops = staged(tops_of(lists), "ngram-tops")
    pairs = staged(close_parities(with_first(lists, tops, percent), sets, percent), "ngram-first")
    answers = verified(pairs, docs, width, percent)
    comp = components(answers.filter("link"))
    labelled = lists.drop("common").join(comp, "id", "left").withColumn("comp", F.coalesce("component", "id")).drop("component")
    labelled = staged(labelled, "ngram-labelled")
    several = labelled.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("token")
    # a row a list; joined to the members once, as two joins by one key in a row can't be split
    heads = staged(several.join(tops.select("token", "id0"), "token"), "ngram-heads")
    rest = labelled.join(heads, "token").withColumn("a", F.least("id", "id0")).withColumn("b", F.greatest("id", "id0"))
    diff = F.when(F.col("id") == F.col("id0"), F.lit(0)).otherwise(F.coalesce("diff", F.lit(-1))).cast("long")
    rest = staged(rest.join(answers.drop("link"), ["a", "b"], "left").withColumn("diff", diff).drop("a", "b", "id0"), "ngram-several")
    whole = rest.filter(F.col("size") <= SHORT).select("token", *[F.lit(0).alias(c) for c in ("pair", "left", "right")], F.lit(-1).alias("block"), "id", "n", "at", "diff", "comp")
    short = close_parities(between_components(whole, percent), sets, percent)
    long = between_components(block_pairs(rest.filter(F.col("size") > SHORT).join(sets.select("id", "parity"), "id"), percent), percent)
    pairs = staged(short.union(long).distinct(), "ngram-rest")
    more = verified(pairs, docs, width, percent)
    comp = components(comp.select(F.col("id").alias("a"), F.col("component").alias("b")).union(more.filter("link").select("a", "b")))
    known = staged(classes.join(comp, classes["rep"] == comp["id"], "left").select("n", "d1", "d2", F.coalesce("component", "rep").alias("component_id"), "rows").filter((F.col("rows") > 1) | (F.col("component_id") != F.col("rep"))), "ngram-known")
    out = rows.join(known, ["n", "d1", "d2"], "left")
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("rows").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(documents(spark, sf_dir))
