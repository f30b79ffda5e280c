"""Near-duplicates: banded MinHash candidates, pruned by sequential Bayesian verification, confirmed on full sets.

A document's set holds the distinct hashes of its five-word shingles. Documents with equal sets are one class from the
start, so a group of copies, however large, is one node. Classes that agree on a band of MinHash values are
candidates. For a candidate pair the values of a second, independent signature are compared batch by batch; with m of n
values equal and a uniform prior the similarity has the posterior Beta(m + 1, n - m + 1), and a pair is given up as soon
as the posterior chance of reaching the threshold is below ``miss``. What survives is decided on the full sets.

No bucket is expanded into pairs. Each bucket first meets only its smallest member; what that links is merged, and only
buckets that still hold several components are looked at again, those of one smallest member together, a block of members
against a block at a time, inside a task that has the full sets and gives only links which connect something new. So no link between components is lost,
a pair is looked at in one bucket only, and a bucket whose members are all alike costs one pair per member.

Shingles are compared by 64-bit hashes (see ``words``): two different shingles of a pair of documents coincide with a
chance of about n^2 / 2^64. A link at the threshold is missed by banding with a chance of (1 - 0.85^6)^30 < 1e-6.

Defined cases: null, empty and wordless texts have empty sets and are linked with nothing; a text of fewer than five
words has its whole word sequence as its only shingle; rows that repeat a document are one class, and
``deduplicate`` keeps one row of them; a row without ``doc_id`` is in no group: its component is null and it is kept. An
empty table gives no rows. Columns of the input with the names of added columns are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialise
from .common import broadcast_if_small
from .words import LOWER, NOT_SPACE, Words, mix, slices, split_words

SHINGLE = 5
#: Sets of 64-bit numbers are stored as little-endian bytes.
SET = "<u8"


@dataclass(frozen=True)
class Settings:
    """``percent``: link at 100 * |A and B| >= percent * |A or B|. ``miss``: chance at which a pair is given up."""

    percent: int = 85
    bands: int = 30
    rows: int = 6
    batch: int = 32
    batches: int = 3
    miss: float = 1e-6
    block: int = 2048
    block_bytes: int = 8 << 20
    seed: int = 17


@lru_cache(maxsize=4)
def _hashing(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    state = np.random.Generator(np.random.PCG64(seed))
    return state.integers(0, 1 << 64, n, dtype=np.uint64), state.integers(0, 1 << 64, n, dtype=np.uint64) | np.uint64(1)


def least_matches(settings: Settings) -> list[int]:
    """For n = batch, 2 batch, ...: the smallest m whose posterior chance of the threshold is not below ``miss``.

    P(Beta(m + 1, n - m + 1) >= t) = P(Binomial(n + 1, t) <= m).
    """
    t, least = settings.percent / 100, []
    for n in range(settings.batch, settings.batch * settings.batches + 1, settings.batch):
        chance, m = (1 - t) ** (n + 1), 0
        while chance < settings.miss:
            m += 1
            chance += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        least.append(m)
    return least


def shingle_sets(words: Words) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every document."""
    whole, counts = words.windows(SHINGLE), words.counts()
    short = {w: words.windows(w) for w in range(1, SHINGLE) if (counts == w).any()}
    out = []
    for d, (a, n) in enumerate(zip(words.first[:-1].tolist(), counts.tolist(), strict=True)):
        out.append(np.unique(whole[a : a + n - SHINGLE + 1]) if n >= SHINGLE else short[n][a : a + 1] if n else whole[:0])
    return out


SIGNED = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n_shingles", T.LongType()), T.StructField("set_a", T.LongType()), T.StructField("set_b", T.LongType()),
    T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("signature", T.BinaryType()),
])


def sign(docs: DataFrame, settings: Settings, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row the set's size and 128-bit fingerprint, its band keys, and the second signature, 16 bits a value."""

    def run(batches):
        n_band = settings.bands * settings.rows
        n = n_band + settings.batch * settings.batches
        flips, scales = _hashing(n, settings.seed)
        for whole in batches:
            for batch in slices(whole, "text"):
                sets = shingle_sets(split_words(batch.column("text"), NOT_SPACE, lower=True))
                sizes = np.array([len(s) for s in sets], dtype=np.int64)
                full, flat = np.flatnonzero(sizes), np.concatenate([*sets, np.zeros(0, dtype=np.uint64)])
                values = np.zeros((len(sets), n), dtype=np.uint64)
                if len(full):
                    begins = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
                    for k in range(n):
                        values[full, k] = np.minimum.reduceat((flat ^ flips[k]) * scales[k], begins)
                bands = np.zeros((len(sets), settings.bands), dtype=np.uint64)
                for r in range(settings.rows):
                    bands = mix(bands + values[:, r:n_band:settings.rows] + np.uint64(1))
                bands = mix(bands + np.arange(1, settings.bands + 1, dtype=np.uint64))
                first, second = np.zeros(len(sets), dtype=np.uint64), np.zeros(len(sets), dtype=np.uint64)
                if len(full):
                    first[full] = mix(np.add.reduceat(mix(flat + np.uint64(0x51ED270B)), begins))
                    second[full] = mix(np.add.reduceat(mix(flat ^ np.uint64(0xC2B2AE3D27D4EB4F)), begins))
                tail = np.ascontiguousarray(values[:, n_band:] >> np.uint64(48)).astype("<u2")
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * settings.bands, pa.int32()), pa.array(bands.reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id"), pa.array(sizes), pa.array(first.view(np.int64)), pa.array(second.view(np.int64)),
                    lists, pa.array([row.tobytes() for row in tail], pa.binary()),
                ], names=SIGNED.names)

    return docs.select(F.col(doc).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, SIGNED)


def _matrix(column: pa.Array, kind: str) -> np.ndarray:
    return np.array([np.frombuffer(x.as_buffer(), dtype=kind) for x in column]) if len(column) else np.zeros((0, 1), dtype=kind)


def survives(a: np.ndarray, b: np.ndarray, settings: Settings) -> np.ndarray:
    """Which rows of two signature matrices stay possible after every batch."""
    alive, equal, least = np.arange(len(a)), np.zeros(len(a), dtype=np.int64), least_matches(settings)
    for i, m in enumerate(least):
        part = slice(i * settings.batch, (i + 1) * settings.batch)
        equal[alive] += (a[alive, part] == b[alive, part]).sum(axis=1)
        alive = alive[equal[alive] >= m]
    out = np.zeros(len(a), dtype=bool)
    out[alive] = True
    return out


PAIR = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def prune(pairs: DataFrame, signatures: DataFrame, settings: Settings) -> DataFrame:
    """The pairs (a, b) that Bayesian verification leaves."""
    one, two = signatures.select(F.col("id").alias("a"), F.col("signature").alias("sa")), signatures.select(F.col("id").alias("b"), F.col("signature").alias("sb"))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                keep = survives(_matrix(batch.column("sa"), "<u2"), _matrix(batch.column("sb"), "<u2"), settings)
                yield batch.select(["a", "b"]).filter(pa.array(keep))

    return pairs.join(one, "a").join(two, "b").select("a", "b", "sa", "sb").mapInArrow(run, PAIR)


SETS = T.StructType([T.StructField("id", T.LongType()), T.StructField("members", T.BinaryType())])


def full_sets(ids: DataFrame, docs: DataFrame, doc: str, text: str, unique: bool) -> DataFrame:
    """``id, members`` for some ids, stored; an id with several texts has several rows."""

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                found = shingle_sets(split_words(batch.column("text"), NOT_SPACE, lower=True))
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([s.astype(SET).tobytes() for s in found], pa.binary())], names=SETS.names)

    source = docs.select(F.col(doc).cast("bigint").alias("id"), F.col(text).alias("text")).join(broadcast_if_small(ids), "id", "left_semi")
    found = source.mapInArrow(run, SETS)
    return materialise(found if unique else found.distinct(), "sets")


def alike(one: np.ndarray, two: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets reach the threshold."""
    small, large = sorted((len(one), len(two)))
    if not small or 100 * small < percent * large:
        return False
    common = len(np.intersect1d(one, two, assume_unique=True))
    return 100 * common >= percent * (len(one) + len(two) - common)


def confirm(pairs: DataFrame, docs: DataFrame, settings: Settings, doc: str, text: str, unique: bool) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold; only texts of documents in ``pairs`` are read again."""
    ids = materialise(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "pair_ids")

    def compare(batches):
        for batch in batches:
            keep = [alike(np.frombuffer(x.as_buffer(), dtype=SET), np.frombuffer(y.as_buffer(), dtype=SET), settings.percent) for x, y in zip(batch.column("ma"), batch.column("mb"), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    stored = full_sets(ids, docs, doc, text, unique)
    one, two = stored.select(F.col("id").alias("a"), F.col("members").alias("ma")), stored.select(F.col("id").alias("b"), F.col("members").alias("mb"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "ma", "mb").mapInArrow(compare, PAIR)


def components(links: DataFrame) -> DataFrame:
    """``id, component`` for the ends of the links (a, b): the smallest id that can be reached.

    Labels move along links and then along themselves, so rounds grow with the logarithm of the longest path. Every
    round is stored; nothing but a count comes to the driver.
    """
    edges = materialise(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = materialise(edges.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    while True:
        sent = edges.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("sent"))
        better = labels.join(sent, "id").select("id", F.least("component", "sent").alias("near"), F.col("component").alias("old"))
        ahead = labels.select(F.col("id").alias("near"), F.col("component").alias("ahead"))
        moved = materialise(better.join(ahead, "near", "left").select("id", F.least("near", F.coalesce("ahead", "near")).alias("component"), "old"), "labels")
        changed, labels = moved.filter("component != old").limit(1).count(), moved.select("id", "component")
        if not changed:
            return labels


def _links_between(ids, labels, band, bands, signatures, sets, left, right, same: bool, settings: Settings) -> list[tuple[int, int]]:
    """Links that join the components of some members of one bucket, enough of them to connect what is connected.

    ``labels``, the members' components, are merged as links are found, and a pair that is connected by then is passed
    over. A pair is looked at in the first band that it shares, so in one bucket only; of a member's partners those with the
    most similar signatures come first.
    """
    out = []
    for n, i in enumerate(left.tolist()):
        rest = right[n + 1 :] if same else right
        rest = rest[labels[rest] != labels[i]]
        if band and len(rest):
            rest = rest[~(bands[rest, :band] == bands[i, :band]).any(axis=1)]
        if len(rest):
            rest = rest[survives(np.broadcast_to(signatures[i], (len(rest), signatures.shape[1])), signatures[rest], settings)]
        for j in rest[np.argsort(-(signatures[rest] == signatures[i]).sum(axis=1), kind="stable")].tolist():
            if labels[j] != labels[i] and alike(sets[i], sets[j], settings.percent):
                labels[labels == labels[j]] = labels[i]
                out.append((int(min(ids[i], ids[j])), int(max(ids[i], ids[j]))))
    return out


def between_components(contested: DataFrame, reps: DataFrame, sets: DataFrame, settings: Settings) -> DataFrame:
    """Links (a, b) between different components inside buckets, from full sets.

    ``contested``: key, band, pivot, id, component. Buckets of near copies mostly have the same pivot, so buckets of
    one pivot are taken together and a member comes once for all of them. If these members are more than ``block``, or their
    sets more than ``block_bytes``, they are cut into blocks that meet two at a time; fewer share a cell with others. Only links
    come out.
    """
    own = contested.groupBy("pivot", "id", "component").agg(F.collect_list(F.struct("key", "band")).alias("buckets"))
    own = own.join(reps, "id").join(sets, "id")
    own = materialise(own, "contested_members")
    size = own.groupBy("pivot").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("members") + 1024).alias("bytes"))
    parts = F.greatest(F.ceil(F.col("n") / settings.block), F.ceil(F.col("bytes") / settings.block_bytes)).cast("int")
    size = materialise(size.select("pivot", parts.alias("parts"), "bytes"), "contested_sizes")
    groups = max(1, -(-(size.filter("parts = 1").agg(F.sum("bytes")).head()[0] or 0) // settings.block_bytes))
    placed = own.join(broadcast_if_small(size.drop("bytes")), "pivot").withColumn("own", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        F.when(F.col("parts") > 1, F.col("pivot")).otherwise(F.pmod(F.xxhash64("pivot"), F.lit(groups))).alias("cell"), (F.col("parts") > 1).alias("large"),
        F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "buckets", "id", "component", "bands", "signature", "members",
    )

    def run(cell: pa.Table) -> pa.Table:
        cell = cell.combine_chunks()
        ids, labels, own = cell.column("id").to_numpy(), cell.column("component").to_numpy().copy(), cell.column("own").to_numpy()
        low, high = cell.column("low")[0].as_py(), cell.column("high")[0].as_py()
        signatures, members = _matrix(cell.column("signature").chunk(0), "<u2"), [np.frombuffer(x.as_buffer(), dtype=SET) for x in cell.column("members")]
        bands = cell.column("bands").chunk(0).flatten().to_numpy().reshape(len(ids), -1)
        lists = cell.column("buckets").chunk(0)
        key, band = (lists.flatten().field(i).to_numpy(zero_copy_only=False) for i in range(2))
        row = np.repeat(np.arange(len(ids)), lists.value_lengths().to_numpy())
        order, out = np.lexsort((ids[row], key)), []
        for bucket in np.split(order, np.flatnonzero(np.diff(key[order])) + 1):
            left, right = row[bucket][own[row[bucket]] == low], row[bucket][own[row[bucket]] == high]
            if len(left) and len(right):
                out += _links_between(ids, labels, int(band[bucket[0]]), bands, signatures, members, left, right, low == high, settings)
        return pa.table([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], names=["a", "b"])

    return placed.groupBy("cell", "large", "low", "high").applyInArrow(run, PAIR)


def link_classes(reps: DataFrame, docs: DataFrame, settings: Settings, doc: str, text: str, unique: bool) -> DataFrame:
    """``id, component`` of the classes that have links. ``reps``: id, bands, signature (stored)."""
    signatures = reps.select("id", "signature")
    keys = reps.select("id", F.posexplode("bands").alias("band", "key"))
    buckets = materialise(keys.groupBy("key").agg(F.min("id").alias("pivot"), F.max("id").alias("_last")).filter("pivot != _last").drop("_last"), "buckets")
    members = materialise(keys.join(broadcast_if_small(buckets), "key").filter("id != pivot"), "members")

    pairs = members.select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct()
    alive = materialise(prune(pairs, signatures, settings), "alive")
    links = materialise(confirm(alive, docs, settings, doc, text, unique), "links")
    labels = components(links)
    current = members.join(labels, "id", "left").select("key", "band", "id", F.coalesce("component", "id").alias("component"))
    open_ = current.groupBy("key").agg(F.min("component").alias("_low"), F.max("component").alias("_high"))
    open_ = materialise(open_.filter("_low != _high").select("key").join(buckets, "key"), "open")
    contested = materialise(current.join(broadcast_if_small(open_), "key"), "contested")
    if not contested.limit(1).count():
        return labels
    ids = materialise(contested.select("id").distinct(), "contested_ids")
    sets = full_sets(ids, docs, doc, text, unique)
    more = materialise(between_components(contested, reps, sets, settings), "links")
    return components(links.unionByName(more)) if more.limit(1).count() else labels


def near_duplicates(docs: DataFrame, settings: Settings = Settings(), doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``doc_id, n_shingles, component_id, kept``."""
    return _grouped(docs, settings, doc, text)[0]


def _grouped(docs: DataFrame, settings: Settings, doc: str, text: str) -> tuple[DataFrame, bool]:
    signed = materialise(sign(docs, settings, doc, text), "signed")
    named = signed.filter("doc_id IS NOT NULL AND n_shingles > 0")
    unique = not signed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 AND doc_id IS NOT NULL").limit(1).count()
    classes = materialise(named.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("id")), "classes")
    chosen = named.select(F.col("doc_id").alias("id"), "set_a", "set_b", "bands", "signature").join(classes, ["id", "set_a", "set_b"], "left_semi")
    if not unique:
        chosen = chosen.dropDuplicates(["id", "set_a", "set_b"])
    reps = materialise(chosen.select("id", "bands", "signature"), "representatives")
    labels = link_classes(reps, docs, settings, doc, text, unique)
    joined = classes.join(labels, "id", "left").select("set_a", "set_b", F.coalesce("component", "id").alias("component"))
    # The class table has one row per set, so rows of a very common set are skewed on one side only, which Spark splits.
    found = signed.drop("bands", "signature").join(joined, ["set_a", "set_b"], "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id")))
    result = found.select("doc_id", "n_shingles", component.cast("bigint").alias("component_id"))
    return result.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))), unique


def deduplicate(docs: DataFrame, settings: Settings = Settings(), doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each group, the one of the smallest id; rows without an id stay."""
    found, unique = _grouped(docs, settings, doc, text)
    gone = materialise(found.filter(~F.col("kept")).select("doc_id").distinct(), "gone")
    # Columns of the input are out of the way in a struct.
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).withColumn("doc_id", F.col(f"row.`{doc}`").cast("bigint"))
    kept = held.join(broadcast_if_small(gone), "doc_id", "left_anti").select("row.*")
    if unique:
        return kept
    return kept.filter(F.col(doc).isNotNull()).dropDuplicates([doc, text]).unionByName(kept.filter(F.col(doc).isNull()))
