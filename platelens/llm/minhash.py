"""Near-duplicate documents by bottom-k sketches from one hash function.

A document's shingle hashes are themselves the values of one hash function; its sketch is the k smallest.
Documents of one shingle set are one class from the start. The classes' sketches are inverted, value by
value. A pair of Jaccard similarity t shares about t*k of the k smallest values of its union; fewer than
`min_overlap` shared values are taken as proof against (for t = 0.85 and k = 128 a pair is lost so with a
probability below 1e-9, and not at all while both sets have at most k values). So a class needs only its
`k - min_overlap + 1` rarest values in the lists, of which unlike documents share few. Candidate pairs are
filtered by the estimate from the union's sketch and verified on the full sets.

Lists are never expanded into all their pairs: in some rounds each list pairs its members with one hub, and what that links is one component. Members of a list that are still in different components are then compared
block by block on their full sets. What leaves a task are links enough to join what the links there join, so no
components stay apart that a link joins, and rows grow with a group's size and not its square.

Defined results: null text or text without words has an empty set, is linked with nothing and is its own
component; rows of one set are linked; a null doc_id never names a component unless its class has no other;
an empty table gives no rows; extra columns don't matter.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .common import discard, materialise, release_memory
from .shingles import shingle_sets

SKETCHED = "doc_id long, n_shingles long, class binary, sketch binary, digest binary"


def sketches(docs: DataFrame, n: int, k: int) -> DataFrame:
    """doc_id, size and 128-bit name of the shingle set, its k smallest values (little-endian), and the text's
    digest."""

    def sketch(batches):
        release_memory()  # of the stages before
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                b = batch.slice(at, 512)
                sets = shingle_sets(b.column(1).to_pylist(), n)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array([s[:k].tobytes() for s in sets], pa.binary()), b.column(2)],
                    ["doc_id", "n_shingles", "class", "sketch", "digest"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), _digest()).mapInArrow(sketch, SKETCHED)


def _digest():
    return F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))).alias("digest")


def _values(classes: DataFrame) -> DataFrame:
    """(class, n, kept, value): a row for each retained value."""

    def spread(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                b = batch.slice(at, 4096)
                values = [np.frombuffer(x, "<i8") for x in b.column(1).to_pylist()]
                sizes = np.array([len(v) for v in values], np.int64)
                rows = np.repeat(np.arange(len(values)), sizes)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), pa.array(sizes[rows].astype(np.int32)), pa.array(np.concatenate(values) if len(values) else np.zeros(0, np.int64))], ["class", "kept", "value"])

    return classes.select("class", "sketch").mapInArrow(spread, "class binary, kept int, value long")


def inverted_lists(classes: DataFrame, k: int, min_share: float) -> DataFrame:
    """(value, class), written: lists of at least two classes, of each class only its rarest values. Two classes with
    at least min_share of their smaller sketch in common meet in one of these lists."""
    values = materialise(_values(classes), "sketch-values")
    shared = values.groupBy("value").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    met = values.join(shared.hint("merge"), "value").select("class", "kept", F.struct("df", "value").alias("entry"))
    # values that nobody shares are the rarest: they fill up a class's prefix first
    per = met.groupBy("class").agg(F.first("kept").alias("kept"), F.array_sort(F.collect_list("entry")).alias("entries"))
    need = F.greatest(F.lit(1), F.ceil(F.col("kept") * min_share)).cast("int")
    room = F.col("kept") - need + 1 - (F.col("kept") - F.size("entries"))
    lists = per.withColumn("room", room).filter("room > 0").select("class", F.explode(F.slice("entries", 1, F.col("room"))).alias("e")).select(F.col("e.value").alias("value"), "class")
    written = materialise(lists, "lists")
    discard(values)
    return written


def _overlap(pairs: DataFrame, named: DataFrame, column: str, judge) -> DataFrame:
    """The pairs (a, b) for which judge(set of a, set of b) holds; `named` has (class, column)."""
    left = named.select(F.col("class").alias("a"), F.col(column).alias("left"), F.col("n_shingles").alias("n_left"))
    right = named.select(F.col("class").alias("b"), F.col(column).alias("right"), F.col("n_shingles").alias("n_right"))
    joined = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").select("a", "b", "left", "right", "n_left", "n_right")

    def verify(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                b = batch.slice(at, 1024)
                ok = [judge(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8"), m, n) for x, y, m, n in zip(*(b.column(i).to_pylist() for i in range(2, 6)))]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return joined.mapInArrow(verify, "a binary, b binary")


def _common(x: np.ndarray, y: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    return int(np.count_nonzero(both[1:] == both[:-1]))


def _joined(group: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The groups (a number below len(group) for each member) once the links (a, b) join them."""
    while len(a) and (group[a] != group[b]).any():
        x, y = group[a], group[b]
        low = np.arange(len(group))
        np.minimum.at(low, np.maximum(x, y), np.minimum(x, y))
        while (low[low] != low).any():
            low = low[low]
        group = low[group]
    return group


def _spanning(group: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places of links that join the same groups as all of (a, b) do, fewer than there are groups: in each round a
    group takes its first link to another one."""
    kept = [np.zeros(0, np.int64)]
    while len(apart := np.flatnonzero(group[a] != group[b])):
        first = np.full(len(group), len(a))
        np.minimum.at(first, group[a[apart]], apart)
        np.minimum.at(first, group[b[apart]], apart)
        kept.append(np.unique(first[first < len(a)]))
        group = _joined(group, a[kept[-1]], b[kept[-1]])
    return np.concatenate(kept)


def _family_links(placed: DataFrame, mixed: DataFrame, sets: DataFrame, num: int, block: int = 256) -> DataFrame:
    """Links (a, b) that join the members of one list that are linked and in different components. Lists of one hub
    are one family. A family is cut into blocks, and a task compares two blocks at a time on their full sets, so a
    task holds at most 2 * `block` sets (on average). Of two blocks' links only those leave it that join what neither
    components nor the links inside a block do, which the block's own task gives."""
    families = materialise(placed.join(mixed.select("value", "hub").hint("merge"), "value").select("hub", "class", "component").distinct(), "families")
    sizes = families.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    dealt = families.join(sizes.hint("merge"), "hub").withColumn("mine", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    spread = dealt.select("hub", "class", "component", "mine", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    keyed = spread.select("hub", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "class", "component")

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        i, j = int(part["i"].iloc[0]), int(part["j"].iloc[0])
        values = [np.frombuffer(x, "<u8") for x in part["set"]]
        sizes_ = np.array([len(v) for v in values])
        rows = np.repeat(np.arange(len(values)), sizes_)
        _, column, often = np.unique(np.concatenate(values), return_inverse=True, return_counts=True)
        shared = often[column] > 1
        rows, column = rows[shared], column[shared]
        column = np.unique(column, return_inverse=True)[1]
        common = np.zeros((len(values), len(values)), np.float32)
        for at in range(0, int(column.max(initial=-1)) + 1, 8192):
            inside = (column >= at) & (column < at + 8192)
            x = np.zeros((len(values), 8192), np.float32)
            x[rows[inside], column[inside] - at] = 1
            common += x @ x.T
        common = np.rint(common).astype(np.int64)
        near = 100 * common >= num * (sizes_[:, None] + sizes_[None, :] - common)
        mine, component, name = part["mine"].to_numpy(), pd.factorize(part["component"])[0], part["class"].to_numpy()
        a, b = np.nonzero(near & (mine[:, None] == mine[None, :]))
        group = component if i == j else _joined(component, a, b)
        if i < j:
            a, b = np.nonzero(near & (mine[:, None] == i) & (mine[None, :] == j))
        chosen = _spanning(group, a, b)
        a, b = a[chosen], b[chosen]
        lo = [min(name[p], name[q]) for p, q in zip(a, b)]
        hi = [max(name[p], name[q]) for p, q in zip(a, b)]
        return pd.DataFrame({"a": lo, "b": hi})

    with_sets = keyed.join(sets.select("class", "set").hint("merge"), "class")
    return with_sets.groupBy("hub", "i", "j").applyInPandas(compare, "a binary, b binary").distinct()


def _components(docs: DataFrame, n: int, num: int, k: int, slack: float, hub_rounds: int) -> tuple[DataFrame, DataFrame]:
    """(the sketches' rows, (class, component) of each class of documents with words)."""
    t = num / 100
    # what a linked pair shares of k values, less `slack` standard deviations
    min_share = max(0.0, t - slack * (t * (1 - t) / k) ** 0.5)
    sketched = materialise(sketches(docs, n, k), "sketches")
    groups = materialise(
        sketched.filter("n_shingles > 0").groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")).alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch")), "classes"
    )
    rows = materialise(sketched.drop("sketch"), "set-names")  # the classes have the sketches
    discard(sketched)
    lists = inverted_lists(groups, k, min_share)

    def estimated(x, y, m, n_):
        if 100 * min(m, n_) < num * max(m, n_):
            return False
        union = np.union1d(x, y)[:k]
        got = np.isin(union, x, assume_unique=True) & np.isin(union, y, assume_unique=True)
        return bool(got.sum() >= (t if len(union) < k else min_share) * len(union) - 1e-9)

    def exact(x, y, m, n_):
        common = _common(x, y)
        return 100 * common >= num * (m + n_ - common)

    # the full sets of the classes that are in any list, made once from a row of each: that of the smallest doc_id,
    # told from others of that id, or of none, by its text
    members = lists.select("class").distinct()
    chosen = groups.join(members.hint("merge"), "class", "left_semi").select("class", F.col("rep.doc_id").alias("__id"), F.col("rep.digest").alias("__text"))
    keyed = docs.select(F.col("doc_id").cast("long").alias("__own"), F.col("text").cast("binary").alias("text"), _digest())
    texts = keyed.join(chosen.hint("merge"), F.col("__own").eqNullSafe(F.col("__id")) & (F.col("digest") == F.col("__text")))

    def full(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                b = batch.slice(at, 256)
                sets = shingle_sets(b.column(0).to_pylist(), n)
                yield pa.RecordBatch.from_arrays([b.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["class", "n_shingles", "set"])

    sets = materialise(texts.select("text", "class").mapInArrow(full, "class binary, n_shingles long, set binary"), "sets").dropDuplicates(["class"])
    links, tried = None, None
    components = groups.select(F.col("class").alias("node"), F.col("class").alias("component")).limit(0)
    for step in range(hub_rounds + 1):
        placed = lists.join(components.withColumnRenamed("node", "class").hint("merge"), "class", "left").select("value", "class", F.coalesce("component", "class").alias("component")) if links is not None else lists.withColumn("component", F.col("class"))
        mixed = placed.groupBy("value").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min_by("class", F.xxhash64(F.lit(step), "class")).alias("hub"), F.min_by("component", F.xxhash64(F.lit(step), "class")).alias("hub_component")).filter("lo <> hi")
        if step == hub_rounds:  # what hubs have not joined
            found = materialise(_family_links(placed, mixed, sets, num), "links")
        else:
            pairs = placed.join(mixed.hint("merge"), "value").filter("component <> hub_component").select(F.least("hub", "class").alias("a"), F.greatest("hub", "class").alias("b")).distinct()
            if tried is not None:
                pairs = pairs.join(tried.hint("merge"), ["a", "b"], "left_anti")
            pairs = materialise(pairs, "pairs")
            if pairs.isEmpty():
                continue
            near = materialise(_overlap(pairs, groups, "sketch", estimated), "near-pairs")
            found = materialise(_overlap(near, sets, "set", exact), "links")
            tried = pairs if tried is None else materialise(tried.unionByName(pairs), "tried")
        links = found if links is None else links.unionByName(found)
        components = connected_components(links.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    named = groups.select("class").join(components.withColumnRenamed("node", "class").hint("merge"), "class", "left")
    return rows, materialise(named.select("class", F.coalesce("component", "class").alias("component")), "components")


def near_duplicates(docs: DataFrame, n: int = 5, num: int = 80, k: int = 128, slack: float = 5.5, hub_rounds: int = 2) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept. Two documents are linked when
    100 * |intersection| >= num * |union| of their n-word shingle sets."""
    rows, components = _components(docs, n, num, k, slack, hub_rounds)
    with_words = rows.filter("n_shingles > 0")
    # a component is named by its smallest doc_id
    per_class = with_words.groupBy("class").agg(F.min("doc_id").alias("rep")).join(components.hint("merge"), "class")
    lowest = per_class.groupBy("component").agg(F.min("rep").alias("component_id"))
    verdict = materialise(components.join(lowest.hint("merge"), "component").select("class", "component_id"), "verdicts")
    linked = with_words.join(verdict.hint("merge"), "class").select("doc_id", "n_shingles", "component_id")
    alone = rows.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, n: int = 5, num: int = 80, k: int = 128, slack: float = 5.5, hub_rounds: int = 2) -> DataFrame:
    """The rows of docs of which one row of each component stays: that of the smallest doc_id (null is larger
    than all) and, where rows share it, of the smallest digest of the text; of rows alike in both, any one. Rows
    without words all stay. The columns of docs, whatever their names."""
    rows, components = _components(docs, n, num, k, slack, hub_rounds)
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")
    per_class = rows.filter("n_shingles > 0").groupBy("class").agg(F.min(first).alias("first"))
    winners = per_class.join(components.hint("merge"), "class").groupBy("component").agg(F.min("first").alias("first")).select("first.doc_id", "first.digest")
    keys = rows.filter("n_shingles = 0").select("doc_id", "digest").unionByName(winners).distinct()
    keys = materialise(keys.select(F.col("doc_id").alias("__id"), F.col("digest").alias("__text")), "winners")
    same = F.col("__own").eqNullSafe(F.col("__id")) & (F.col("__digest") == F.col("__text"))
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("__own"), _digest().alias("__digest"))
    kept = keyed.join(keys.hint("merge"), same, "left_semi")
    # rows alike in id and text: few, and none behind an exact dedup
    again = materialise(rows.filter("n_shingles > 0").groupBy(F.col("doc_id").alias("__id"), F.col("digest").alias("__text")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "repeated")
    if not again.isEmpty():
        once = kept.join(again.hint("merge"), same, "left_semi").groupBy("__own", "__digest").agg(F.first("row").alias("row")).select("row", "__own", "__digest")
        kept = kept.join(again.hint("merge"), same, "left_anti").unionByName(once)
    return kept.select("row.*")
