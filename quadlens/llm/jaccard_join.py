"""N-gram Jaccard join by adaptive multi-match prefixes, and the connected classes of its links.

1. Sets. A document's set holds the hashes of its n-word shingles. Documents with equal sets (128 bits of
   hash) form one class with the smallest doc_id for a representative; copies are never expanded into
   pairs. `shared_keys` tells which shingles of a set any other set has; only those can count for an
   intersection. A set whose shared shingles are fewer than its least overlap (threshold x size) can have no
   link and is done.
2. Order. Shared shingles are ordered by how many sets hold them, rarest first. The counts come from all sets,
   in a table of 2^BINS numbers: a shingle counts as its bin, so that frequent ones stand out at any size.
3. Prefixes. Partners i and j need an overlap o of at least percent (n_i + n_j) / (100 + percent), so they share
   at least one of the first s - o + 1 of their s shared shingles each: these make the inverted lists.
4. Leaders. In large families of near copies most pairs would be candidates. So first every member of an
   inverted list meets one leader only, the member with the fewest shingles of its own; links found join
   components. From then on only pairs of different components count.
5. Adaptive matches. A pair becomes a candidate if it shares as many prefix tokens as its overlap asks for. A
   set's cost is the number of list entries of other components it would meet, over the tokens a pair must share. Sets
   whose cost is at most `limit`, and whose lists have no more of them, meet them all and are settled. The others need more matches: shingles that the same
   unsettled sets hold become one weighted token; the prefix is lengthened until m tokens of it must be shared,
   and what is indexed is each m of them together, so that a pair comes up only if it shares m. m grows by one
   as long as the cost stays above the limit, up to MATCHES, or until a longer prefix would no longer help (one
   token outweighs the overlap) or have more than MOST_KEYS combinations; then all partners are met, in cells
   of at most some `limit` x `limit` entries each, however long the list is.
   So pairs grow with the number of sets, whatever its lists hold, but for sets that MATCHES tokens do not tell apart.
   From the first lists on a set carries a sketch, its tokens' parities in SKETCH x 64 bits: bits that differ tell the least
   number of tokens that only one of two sets has, and where that leaves no room for a link the pair is never made. After
   each m the links found join components, so that the next m meets fewer.
6. Verification by array_intersect of the sets that are in a pair, no others being shipped; components by smallest-label propagation with pointer jumping.

Keys that very many rows have (a token, a group of copies) are joined by broadcast, see join_hot.

Defined results: a null, empty or wordless text has an empty set and is linked with nothing (its component
is its own id); fewer than n words count as one shingle; rows with a null doc_id take no part and give no
row (keep_one keeps them); rows that repeat a doc_id are one document; extra columns are passed through by
keep_one and left out of jaccard_components, whatever their names; an empty table gives an empty result.
Shingles are told apart by 64 bits of hash within a document and by 48 within a pair of documents.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadlens.llm import shared_keys as K
from quadlens.llm.common import as_before, join_hot, new_path, staged, whole_rows

BINS = 20  # bits of a shingle that choose its bin
LIMIT = 256  # entries of a list that are met without asking for more matches
MATCHES, MOST_KEYS = 4, 128
SKETCH = 8  # words of 64 bits
INFO = "doc_id long, n_shingles long, fp1 long, fp2 long, shared array<long>"
SETS = 3


def checkpointed(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: compressed, and of known size, which a checkpoint is not (its guesses multiply in loops of joins)."""
    return staged(df, new_path(df.sparkSession, "jaccard"))


def shingle_hashes(text: bytes, n: int) -> tuple[int, np.ndarray]:
    """How many distinct n-word shingles a text has, and their sorted 48-bit hashes. bytes.lower and bytes.split know ASCII only, as the rule does."""
    words = text.lower().split()
    if not words:
        return 0, np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    if len(h) < n:
        return 1, np.array([xxhash.xxh3_64_intdigest(h.tobytes(), 1) >> 16], np.uint64)
    out = h[: len(h) - n + 1].copy()
    for i in range(1, n):
        out = K.mixed(out * K.MIX + h[i : len(h) - n + 1 + i])
    out = np.sort(out)
    keys = out >> np.uint64(16)
    return int((out[1:] != out[:-1]).sum()) + 1, keys[np.concatenate([[True], keys[1:] != keys[:-1]])]


def least_overlap(size, percent: int):
    """ceil(percent / 100 * size) in whole numbers."""
    return -(-percent * size // 100)


def document_sets(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """INFO of each document, without shared; and of each set that can have a link, with shared and without doc_id.

    Keys travel with half a print for a set's name. Where two sets have the same half, shared is null for both
    (see `reset`).
    """
    size = K.text_bytes(docs)
    buckets = blocks = max(8, size // (8 << 20))  # some 10 MB of keys each
    deal = K.Deal(buckets, blocks)

    def emit(ids, texts):
        sizes, sets = zip(*(shingle_hashes(t, n) for t in texts))
        sizes, held = np.array(sizes, np.int64), np.array([len(s) for s in sets], np.int64)
        prints = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), np.int64)
        fp1, fp2 = prints[0::2], prints[1::2]
        once = np.sort(np.unique(prints.reshape(-1, 2), axis=0, return_index=True)[1])
        rows = K.key_rows(fp1[once], np.concatenate([sets[i] for i in once]), np.repeat(np.arange(len(once)), held[once]), deal)
        for p, i in K.by_part(K.block_of(ids, blocks), blocks):
            rows.append((p % buckets, p, K.PAYLOAD, K.packed(ids[i], sizes[i], fp1[i], fp2[i])))
        for p, i in K.by_part(K.block_of(fp1[once], blocks), blocks):
            rows.append((p % buckets, p, SETS, K.packed(sizes[once[i]], fp1[once[i]], fp2[once[i]])))
        return rows

    def finish(table: pa.Table) -> pa.Table:
        told, sets, found = [], [], []
        for kind, blob in zip(table.column("kind").to_pylist(), table.column("blob").to_pylist()):
            if kind == K.PAYLOAD:
                told.append(K.unpacked(blob))
            elif kind == SETS:
                sets.append(K.unpacked(blob))
            else:
                found.append(K.entries(blob))
        empty = np.zeros(0, np.int64)
        ids, sizes, fp1, fp2 = (np.concatenate(x) for x in zip(*told)) if told else [empty] * 4
        of_set, set1, set2 = (np.concatenate(x) for x in zip(*sets)) if sets else [empty] * 3
        once = np.unique(np.stack([set1, set2], 1), axis=0, return_index=True)[1]
        of_set, set1, set2 = of_set[once], set1[once], set2[once]
        twice = np.concatenate([[False], set1[1:] == set1[:-1], [False]])
        twice = twice[1:] | twice[:-1]  # different sets with the same first half of their print: their keys are mixed up
        doc = np.concatenate([d for d, _ in found]) if found else empty
        key = np.concatenate([k for _, k in found]) if found else np.zeros(0, np.uint64)
        found.clear()
        order = np.lexsort((key, doc))
        doc, key = doc[order], key[order]
        if len(key):  # the same set of another group tells the same keys again
            new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])])
            doc, key = doc[new], key[new]
        a, b = np.searchsorted(doc, set1), np.searchsorted(doc, set1, "right")
        able = np.flatnonzero(((b - a >= least_overlap(of_set, percent)) & (of_set > 0)) | twice)
        a, lengths, mixed_up = a[able], (b - a)[able], twice[able]
        lengths[mixed_up] = 0
        take = np.repeat(a - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
        offsets = np.concatenate([np.zeros(len(ids) + 1, np.int64), np.cumsum(lengths)]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(key[take].view(np.int64)), mask=pa.array(np.concatenate([np.ones(len(ids), bool), mixed_up])))
        both = [np.concatenate(x) for x in ((sizes, of_set[able]), (fp1, set1[able]), (fp2, set2[able]))]
        doc_id = pa.concat_arrays([pa.array(ids), pa.nulls(len(able), pa.int64())])
        return pa.table([doc_id, *map(pa.array, both), lists], ["doc_id", "n_shingles", "fp1", "fp2", "shared"])

    return K.shared_blobs(docs, emit, deal).groupBy("block").applyInArrow(finish, INFO)


def reset(told: DataFrame, info: DataFrame, docs: DataFrame, n: int) -> DataFrame:
    """The sets that document_sets could not tell apart (of 10^10 sets a few at most), with all their shingles as shared ones."""
    lost = checkpointed(told.where("doc_id IS NULL AND shared IS NULL").select("fp1", "fp2"))
    schema = "fp1 long, fp2 long, n_shingles long, shared array<long>"
    if lost.isEmpty():
        return docs.sparkSession.createDataFrame([], schema)
    ids = info.join(lost, ["fp1", "fp2"]).groupBy("fp1", "fp2").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"))

    def sets(batches):
        for b in batches:
            lists = [shingle_hashes((t or "").encode(), n)[1].view(np.int64) for t in b.column("text").to_pylist()]
            yield pa.record_batch([b.column("fp1"), b.column("fp2"), b.column("n_shingles"), pa.array(lists, pa.list_(pa.int64()))], ["fp1", "fp2", "n_shingles", "shared"])

    return docs.select("doc_id", "text").join(ids, "doc_id").dropDuplicates(["fp1", "fp2"]).select("fp1", "fp2", "n_shingles", "text").mapInArrow(sets, schema)


def bin_counts(sets: DataFrame) -> np.ndarray:
    """How many of the sets' shared shingles fall into each bin."""
    parts = 64

    def count(batches):
        total = np.zeros(1 << BINS, np.int64)
        for b in batches:
            total += np.bincount(b.column("shared").flatten().to_numpy() >> (48 - BINS), minlength=1 << BINS)
        for k, x in enumerate(total.reshape(parts, -1)):
            if x.any():
                yield pa.record_batch([pa.array([k], pa.int32()), pa.array([K.packed(x)], pa.binary())], ["part", "blob"])

    def add(table):
        total = sum(K.unpacked(x)[0] for x in table.column("blob").to_pylist())
        return pa.table([table.column("part").slice(0, 1), pa.array([K.packed(total)], pa.binary())], ["part", "blob"])

    out = np.zeros((parts, (1 << BINS) // parts), np.int64)
    for r in sets.select("shared").mapInArrow(count, "part int, blob binary").groupBy("part").applyInArrow(add, "part int, blob binary").collect():
        out[r["part"]] = K.unpacked(bytes(r["blob"]))[0]
    return out.reshape(-1)


def rarest_first(sets: DataFrame, counts: np.ndarray) -> DataFrame:
    """sets with shared in the order of its bins' counts, equal counts in the order of the shingles, and bits (its sketch)."""
    table, names = sets.sparkSession.sparkContext.broadcast(counts), sets.columns  # 2^BINS numbers

    def run(batches):
        for b in batches:
            lists = b.column("shared")
            token, edge = lists.flatten().to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            row = np.repeat(np.arange(len(edge) - 1), np.diff(edge))
            token = token[np.lexsort((token, table.value[token >> (48 - BINS)], row))]
            columns = [pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(token)) if c == "shared" else b.column(c) for c in names]
            bits = np.zeros((len(edge) - 1) * SKETCH, np.uint64)
            np.bitwise_xor.at(bits, row * SKETCH + (token >> 6) % SKETCH, np.uint64(1) << (token & 63).astype(np.uint64))
            bits = pa.ListArray.from_arrays(pa.array(np.arange(len(edge)) * SKETCH, pa.int32()), pa.array(bits.view(np.int64)))
            yield pa.record_batch([*columns, bits], [*names, "bits"])

    return sets.mapInArrow(run, T.StructType([*sets.schema, T.StructField("bits", T.ArrayType(T.LongType()))]))


def open_entries(entries: DataFrame) -> DataFrame:
    """Of entries (rep, comp, token and more) those in lists of several components, with held (the list's length), major
    (its largest component), n_major and others (how many are of another component)."""
    per = checkpointed(entries.groupBy("token", "comp").agg(F.count("*").alias("k")))
    lists = per.groupBy("token").agg(F.sum("k").alias("held"), F.max(F.struct("k", "comp")).alias("top")).where("held > top.k")
    lists = lists.select("token", "held", F.col("held").alias("n"), F.col("top.comp").alias("major"), F.col("top.k").alias("n_major"))
    per = join_hot(per, lists, ["token"]).withColumn("others", F.col("held") - F.col("k"))
    return checkpointed(join_hot(entries, per, ["token", "comp"], "k"))


def settled_pairs(entries: DataFrame, percent: int, limit: int, sketches: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of different components with shared tokens in entries (rep, n, s, comp, token, forced), for all pairs
    with a settled or forced one of the two; and the rep of all others.

    Entries have their sets' sketches (bits), or sketches (rep, bits) is given. Then the tokens are those of prefixes of
    s - o + 1 tokens, with o a set's own least overlap. A pair's overlap is at most its shared ones and the o - 1 beyond the
    prefix, so a pair must share as many as make up its own overlap.
    """
    prefixes = sketches is not None
    entries = open_entries(entries)
    possible = _feasible(percent) & F.expr("comp <> comp_2 AND rep <> rep_2")
    need = F.expr(_needed(percent).replace("n_2", "n") if prefixes else "1")  # of a partner of the same size
    few = (F.max("others") <= limit) & (F.sum("others") <= limit * F.first(need))
    cost = checkpointed(entries.groupBy("rep").agg(few.alias("settled"), F.first("forced").alias("_f")))
    told = cost.drop("_f").join(sketches, "rep") if prefixes else cost.drop("_f")
    entries = checkpointed(entries.join(told, "rep"))
    side = ["rep", "n", "s", "comp", "bits"]
    second = [F.col(c).alias(f"{c}_2") for c in side]
    possible = possible & F.expr(_sketches_allow(percent))
    # members of a list's largest component meet its other entries, of which a settled set has at most `limit`
    minor = entries.where(F.expr(f"comp <> major AND held - n_major <= {limit}"))
    minor = minor.groupBy("token").agg(F.collect_list(F.struct(*second)).alias("others"), F.first("n_major").alias("n_major"))
    major = join_hot(entries.where("settled AND comp = major").select("token", *side), minor, ["token"], "n_major")
    pairs = major.select(*side, F.explode(F.filter("others", lambda o: _able(percent, o))).alias("o")).select(*side, "o.*")
    # all others that are settled are in short lists; a pair that has come up for this token does not come up again
    small = entries.where(f"held <= {2 * limit}").select("token", *second, F.col("settled").alias("settled_2"))
    again = "settled_2 AND (comp_2 = major OR rep_2 < rep)"
    pairs = pairs.unionByName(entries.where("settled AND comp <> major").join(small, "token").where(f"NOT ({again})").where(possible).select(*pairs.columns))
    forced = entries.where("forced AND NOT settled")
    if not forced.isEmpty():
        most = max(limit, 32)
        cells = F.expr(f"(held + {most - 1}) div {most}")
        every = F.explode(F.sequence(F.lit(0), cells - 1))
        own = F.pmod(F.xxhash64("rep"), cells)
        rows = forced.select("token", *side, own.alias("i"), every.alias("j"))
        columns = entries.join(forced.select("token").distinct(), "token", "left_semi").select("token", *second, every.alias("i"), own.alias("j"))
        pairs = pairs.unionByName(rows.join(columns, ["token", "i", "j"]).where(possible).select(*pairs.columns))
    pairs = pairs.where(possible)
    pairs = pairs.select(F.least("rep", "rep_2").alias("a"), F.greatest("rep", "rep_2").alias("b"), F.expr(_needed(percent) if prefixes else "1").alias("need"))
    pairs = pairs.groupBy("a", "b", "need").agg(F.count("*").alias("shared")).where("shared >= need").select("a", "b")
    return checkpointed(pairs), cost.where("NOT settled AND NOT _f").select("rep")


def _sketches_allow(percent: int, two: str = "{}_2") -> str:
    """Whether the tokens that surely are in one of two sets only leave room for a link."""
    n, s, bits = (two.format(c) for c in ("n", "s", "bits"))
    apart = " + ".join(f"bit_count(bits[{i}] ^ {bits}[{i}])" for i in range(SKETCH))
    return f"{100 + percent} * (n + {n} - (n - s) - ({n} - {s}) - ({apart})) >= {2 * percent} * (n + {n})"


def _able(percent: int, o: Column) -> Column:
    """`_feasible` and `_sketches_allow` for an element of a list, and the two are of different components."""
    n, apart = F.col("n") + o["n_2"], F.col("n") - F.col("s") + o["n_2"] - o["s_2"]
    for i in range(SKETCH):
        apart = apart + F.bit_count(F.col("bits")[i].bitwiseXOR(o["bits_2"][i]))
    feasible = (100 + percent) * F.least(F.col("s"), o["s_2"]) >= percent * n
    return (F.col("comp") != o["comp_2"]) & feasible & ((100 + percent) * (n - apart) >= 2 * percent * n)


def _needed(percent: int) -> str:
    """How many tokens of their prefixes two sets of n and n_2 must share."""
    own = lambda n: f"({percent} * {n} + 99) div 100"
    return f"({percent} * (n + n_2) + {99 + percent}) div {100 + percent} - greatest({own('n')}, {own('n_2')}) + 1"


def weighted_tokens(sets: DataFrame) -> DataFrame:
    """rep, n, s, bits (the sketch) and tokens (id, weight; rarest first): the shingles of sets that the same of these hold are one token."""
    rows = checkpointed(sets.select("rep", F.explode("shared").alias("token")))
    twins = rows.groupBy("token").agg(F.bit_xor(F.xxhash64("rep")).alias("print"), F.count("*").alias("df")).where("df > 1")
    twins = twins.select("token", F.xxhash64("print", "df").alias("id"), "df", F.col("df").alias("held"))
    words = [F.expr(f"bit_xor(if((token >> 6) % {SKETCH} = {i}, shiftleft(1L, cast(token & 63 AS int)), 0L))").alias(f"b{i}") for i in range(SKETCH)]
    tokens = join_hot(rows, twins, ["token"], "held").groupBy("rep", "df", "id").agg(F.count("*").alias("w"), *words)
    bits = F.array(*[F.bit_xor(f"b{i}") for i in range(SKETCH)]).alias("bits")
    tokens = tokens.groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("df", "id", "w"))).alias("t"), F.sum("w").alias("s"), bits)
    return sets.select("rep", "n").join(tokens.select("rep", "s", "bits", F.col("t.id").alias("ids"), F.col("t.w").alias("weights")), "rep")


def match_prefix(weights: list[int], overlap: int, m: int) -> int | None:
    """The shortest prefix of which partners of this overlap must share m tokens; None if there is none."""
    rest, top = sum(weights), []
    for p, w in enumerate(weights, 1):
        rest -= w
        top = sorted([*top, w], reverse=True)[: m - 1]
        if p >= m and sum(top) + rest < overlap:
            return p
    return None


@lru_cache(maxsize=256)
def _choices(p: int, m: int) -> np.ndarray:
    return np.array(list(combinations(range(p), m)), np.int64).reshape(-1, m)


def match_keys(profile: DataFrame, percent: int, m: int) -> DataFrame:
    """rep, n, s, comp, bits, token, forced: each m tokens of a set's prefix as one token; forced if m + 1 would not do."""
    def run(batches):
        for b in batches:
            rows = []
            for i, (n, ids, weights) in enumerate(zip(*(b.column(c).to_pylist() for c in ("n", "ids", "weights")))):
                o = least_overlap(n, percent)
                p = match_prefix(weights, o, m)
                if sum(weights) < o or p is None:
                    continue
                longer = match_prefix(weights, o, m + 1) if m < MATCHES else None
                forced = longer is None or comb(longer, m + 1) > MOST_KEYS
                ids, key = np.array(ids[:p], np.int64).view(np.uint64), np.full(comb(p, m), m, np.uint64)
                for at in _choices(p, m).T:
                    key = K.mixed(key * K.MIX + ids[at])
                rows.append((i, np.unique(key).view(np.int64), forced))
            take = np.repeat(np.array([i for i, _, _ in rows], np.int64), [len(k) for _, k, _ in rows])
            keep = [b.column(c).take(pa.array(take)) for c in ("rep", "n", "s", "comp", "bits")]
            tokens = np.concatenate([k for _, k, _ in rows]) if rows else np.zeros(0, np.int64)
            forced = np.repeat(np.array([f for _, _, f in rows], bool), [len(k) for _, k, _ in rows])
            yield pa.record_batch([*keep, pa.array(tokens), pa.array(forced)], ["rep", "n", "s", "comp", "bits", "token", "forced"])

    return profile.mapInArrow(run, "rep long, n long, s long, comp long, bits array<long>, token long, forced boolean")


def later_links(entries: DataFrame, reps: DataFrame, comp: DataFrame, percent: int, limit: int = LIMIT) -> DataFrame:
    """node, comp once the sets of different components meet, from comp and the entries (rep, n, s, token) of the inverted lists."""
    of_comp = lambda rows: rows.join(comp.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    pairs, hot = settled_pairs(of_comp(entries).withColumn("forced", F.lit(False)), percent, limit, reps.select("rep", "bits"))
    comp = joined(comp, verified(pairs, reps, percent))
    if hot.isEmpty():
        return comp
    profile = checkpointed(weighted_tokens(reps.join(hot, "rep", "left_semi")))
    for m in range(1, MATCHES + 1):
        pairs, hot = settled_pairs(match_keys(of_comp(profile), percent, m), percent, limit)
        comp = joined(comp, verified(pairs, reps, percent))
        if hot.isEmpty():
            break
        profile = checkpointed(profile.join(hot, "rep", "left_semi"))
    return comp


def _feasible(percent: int, a: str = "", b: str = "_2") -> Column:
    """Whether two documents' sizes and shared counts leave room for a link."""
    s = F.least(F.col(f"s{a}"), F.col(f"s{b}"))
    return (100 + percent) * s >= percent * (F.col(f"n{a}") + F.col(f"n{b}"))


def verified(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Those of pairs (a, b) that link. Only sets that are in a pair are shipped: their names are few and broadcast, or else
    they are dealt as the join needs them anyway."""
    def side(x):
        sets = reps.select(F.col("rep").alias(x), F.col("n").alias(f"n_{x}"), F.col("shared").alias(f"of_{x}"))
        return sets.join(pairs.select(x), x, "left_semi")

    both = F.size(F.array_intersect("of_a", "of_b"))
    met = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")
    return met.where((100 + percent) * both >= percent * (F.col("n_a") + F.col("n_b"))).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """node, comp: the smallest node each node of links (a, b) is connected with."""
    edges = checkpointed(links.select("a", "b").union(links.select("b", "a")).distinct())
    labels = checkpointed(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("comp")))
    while True:
        heard = edges.join(labels.select(F.col("node").alias("b"), F.col("comp").alias("heard")), "b").groupBy(F.col("a").alias("node")).agg(F.min("heard").alias("heard"))
        step = labels.join(heard, "node").select("node", F.col("comp").alias("old"), F.least("comp", "heard").alias("comp"))
        jump = labels.select(F.col("node").alias("comp"), F.col("comp").alias("root"))
        step = checkpointed(step.join(jump, "comp", "left").select("node", "old", F.least("comp", F.coalesce("root", "comp")).alias("comp")))
        labels = step.select("node", "comp")
        if not step.where("old <> comp").limit(1).count():
            return labels


def joined(comp: DataFrame, links: DataFrame) -> DataFrame:
    """comp (node, comp) after more links (a, b); only the components that these meet are looked at."""
    for end in ("a", "b"):
        links = links.join(comp.select(F.col("node").alias(end), F.col("comp").alias("of")), end, "left").withColumn(end, F.coalesce("of", end)).drop("of")
    links = checkpointed(links.where("a <> b").distinct())
    if links.isEmpty():
        return comp
    into = components(links).select(F.col("node").alias("comp"), F.col("comp").alias("root"))
    moved = comp.join(into, "comp", "left").select("node", F.coalesce("root", "comp").alias("comp"))
    alone = into.join(comp.select(F.col("node").alias("comp")), "comp", "left_anti").select(F.col("comp").alias("node"), F.col("root").alias("comp"))
    return checkpointed(moved.unionByName(alone))


def jaccard_components(docs: DataFrame, n: int = 5, percent: int = 80, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_shingles, component_id of each document; documents link at percent/100 Jaccard similarity or more."""
    docs = docs.select("doc_id", "text")
    told = checkpointed(document_sets(docs, n, percent))
    info = told.where("doc_id IS NOT NULL").drop("shared").dropDuplicates(["doc_id"])
    classes = checkpointed(info.where("n_shingles > 0").groupBy("fp1", "fp2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("held")))
    sets = told.where("shared IS NOT NULL").select("fp1", "fp2", "n_shingles", "shared").unionByName(reset(told, info, docs, n))
    counts = bin_counts(sets)
    reps = sets.join(classes, ["fp1", "fp2"]).select("rep", F.col("n_shingles").alias("n"), F.size("shared").cast("long").alias("s"), "shared")
    reps = checkpointed(rarest_first(reps, counts))
    # one leader for each inverted list
    spare = F.expr(f"cast(s - ({percent} * n + 99) div 100 as int)")
    rows = checkpointed(reps.select("rep", "n", "s", F.explode(F.slice("shared", F.lit(1), spare + 1)).alias("token")))
    lists = rows.groupBy("token").agg(F.count("*").alias("held"), F.min(F.struct((F.col("n") - F.col("s")).alias("own"), "rep", "n", "s")).alias("l")).where("held > 1")
    lists = lists.select("token", "held", F.col("l.rep").alias("rep_2"), F.col("l.n").alias("n_2"), F.col("l.s").alias("s_2"))
    entries = checkpointed(join_hot(rows, lists, ["token"], "held"))
    met = entries.where("rep <> rep_2").where(_feasible(percent)).groupBy("rep", "rep_2").agg(F.count("*").alias("shared"))
    nth = F.row_number().over(Window.partitionBy("rep").orderBy(F.desc("shared"), "rep_2"))
    met = met.withColumn("nth", nth).where("nth <= 2").select(F.col("rep").alias("a"), F.col("rep_2").alias("b"))
    links = checkpointed(verified(met, reps, percent))
    comp = components(links)
    # the rest: candidates of different components
    comp = later_links(checkpointed(entries.select("rep", "n", "s", "token")), reps, comp, percent, limit)
    of_class = classes.join(comp.withColumnRenamed("node", "rep"), "rep", "left").select("fp1", "fp2", "held", F.coalesce("comp", "rep").alias("component_id"))
    out = join_hot(info.where("n_shingles > 0"), of_class, ["fp1", "fp2"], "held").select("doc_id", "n_shingles", "component_id")
    return out.unionByName(info.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """docs without the documents that have a smaller doc_id in their component; rows with a null doc_id stay."""
    drop = jaccard_components(docs, n, percent).where("component_id <> doc_id").select(F.col("doc_id").alias("gone"))
    return as_before(whole_rows(docs, "doc_id").join(drop, F.col("doc_id") == F.col("gone"), "left_anti"), docs)
