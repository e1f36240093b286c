"""Near-duplicate components by SetSketch registers, banding, likelihood and exact verification.

Documents with the same set of word shingles are one class, whatever their number. Each class has
a SetSketch: for register i the minimum of exponential variables over the set, kept as a floor on
an exponential scale and truncated. Registers merge by maximum and agree with a probability that grows
with the Jaccard similarity, so runs of registers (bands) are the buckets in which pairs are looked for:

1. in each bucket every class meets one pivot, the class of least number, and not every other class;
2. pairs pass if the likelihood of their registers allows the wanted similarity, then by exact sets;
3. in buckets that still hold several components, classes outside the largest component meet the
   members of all other components, so no link between components is left out. Pairs that can't be
   similar don't arise: what two sets share within the largest component's document, and beyond it
   of what several classes have, is bounded before they are paired.

Links and labels stay in tables; components come from rounds of hooking, pointer jumping and contraction.
Classes are numbered, so rows that share a document id but not their text are apart everywhere.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .common import materialize, maybe_broadcast
from .textwords import fingerprint, mix, split_words, windows

#: Registers in a band, and bands. At similarity 0.8 a pair misses all bands once in 20 million.
ROWS, BANDS = 4, 32
#: SetSketch parameters: base of the scale, rate of the exponential variables, largest register.
BASE, RATE, TOP = 1.001, 20.0, 65535
#: A pair is dropped before verification if the wanted similarity is exp(-LIKELIHOOD) times less likely than the best one.
LIKELIHOOD = 12.0
#: 64-bit words of a bitmap of the shingles in which a set differs from another.
WORDS = 8

_M = ROWS * BANDS
_KEYS = mix(np.arange(1, 2 * _M + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_XOR, _MUL = _KEYS[:_M], _KEYS[_M:] | np.uint64(1)


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct fingerprints of the text's shingles; of the whole sequence if it is shorter; none without words."""
    words = split_words(text, fold=True)
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(windows(fingerprint(words), min(size, len(words))))


def registers(shingles: np.ndarray) -> np.ndarray:
    """floor(1 - log_b(x)) of the least exponential variable x of each register, within 0..TOP."""
    least = np.full(_M, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(shingles), 512):
        least = np.minimum(least, ((shingles[k : k + 512, None] ^ _XOR) * _MUL).min(axis=0))
    u = (least.astype(np.float64) + 1.0) / 2.0**64
    x = -np.log1p(-np.minimum(u, 1 - 1e-16)) / RATE
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, TOP).astype(np.uint16)


def log_likelihood(j, sizes_a, sizes_b, more, less, same) -> np.ndarray:
    """Joint likelihood of a similarity j, from how many registers of a are above, below and equal to those of b."""
    u = sizes_a / (sizes_a + sizes_b)
    p = lambda x: -np.log1p(-np.clip(x, 1e-12, 1 - 1e-12) * (BASE - 1) / BASE) / np.log(BASE)
    above, below = p(u - (1 - u) * j), p((1 - u) - u * j)
    return more * np.log(above) + less * np.log(below) + same * np.log(np.maximum(1 - above - below, 1e-12))


def plausible(regs_a: np.ndarray, regs_b: np.ndarray, sizes_a, sizes_b, least: float) -> np.ndarray:
    """Whether a similarity of ``least`` or more isn't ruled out by the registers."""
    more, less = (regs_a > regs_b).sum(1), (regs_a < regs_b).sum(1)
    same = regs_a.shape[1] - more - less
    grid = np.linspace(0.0, 1.0, 51)[1:-1]
    top = np.minimum(sizes_a / sizes_b, sizes_b / sizes_a)  # no similarity is higher
    values = np.stack([log_likelihood(np.minimum(g, top), sizes_a, sizes_b, more, less, same) for g in grid])
    upper = np.where((grid >= least)[:, None], values, -np.inf).max(0)
    return (upper > values.max(0) - LIKELIHOOD) & (top >= least - 1e-9)


def sketch(docs: DataFrame, size: int) -> DataFrame:
    """(_id, _key, n_shingles, digest of the set, registers) for (_id, _key, _text) rows."""

    def run(batches):
        for batch in batches:
            counts, digests, regs = [], [], []
            for text in batch.column(2):
                s = shingle_set(text.as_py(), size)
                counts.append(len(s))
                digests.append(hashlib.md5(s.tobytes()).digest())
                regs.append(registers(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), pa.array(regs, pa.binary())], names=["_id", "_key", "n_shingles", "digest", "regs"])

    return docs.mapInArrow(run, f"_id {docs.schema['_id'].dataType.simpleString()}, _key long, n_shingles long, digest binary, regs binary")


def band_rows(classes: DataFrame) -> DataFrame:
    """(rep, band, value) for each band of each class; four 16-bit registers are the value as it stands."""

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            regs = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int64).reshape(n, BANDS)
            reps = batch.column(0).take(pa.array(np.repeat(np.arange(n), BANDS)))
            yield pa.RecordBatch.from_arrays([reps, pa.array(np.tile(np.arange(BANDS, dtype=np.int16), n)), pa.array(regs.ravel())], names=["rep", "band", "value"])

    return classes.select("rep", "regs").mapInArrow(run, "rep long, band short, value long")


def _likely(pairs: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    a = classes.select(F.col("rep").alias("a"), F.col("regs").alias("ra"), F.col("n_shingles").alias("na"))
    b = classes.select(F.col("rep").alias("b"), F.col("regs").alias("rb"), F.col("n_shingles").alias("nb"))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                ra, rb = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(batch.num_rows, _M) for c in ("ra", "rb"))
                na, nb = (batch.column(c).to_numpy().astype(np.float64) for c in ("na", "nb"))
                yield batch.filter(pa.array(plausible(ra, rb, na, nb, least))).select(["a", "b"])

    return pairs.join(a, "a").join(b, "b").mapInArrow(run, "a long, b long")


def _exact(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    a = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("sa"))
    b = sets.select(F.col("rep").alias("b"), F.col("shingles").alias("sb"))

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("sa"), batch.column("sb")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.sort(np.concatenate([x, y]), kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(both) - common))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    return pairs.join(a, "a").join(b, "b").mapInArrow(run, "a long, b long")


def bitmap(values: np.ndarray) -> np.ndarray:
    """Bitmap of WORDS 64-bit numbers with a bit for the hash of each value."""
    at = mix(values) % np.uint64(64 * WORDS)
    out = np.zeros(WORDS, np.uint64)
    np.bitwise_or.at(out, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
    return out.view(np.int64)


def against_main(pairs: DataFrame, sets: DataFrame, classes: DataFrame) -> DataFrame:
    """For each class and the class that names its bucket's largest component: (rep, main, size, main_size, extra, lacks0.., has0.., v0..).

    extra is how much of the class's set is not in that document; lacks and has are bitmaps of what only
    the document and only the class have, in WORDS numbers each. They bound from above what two such sets share.
    v are the class's values in all bands.
    """
    a = sets.select("rep", F.col("shingles").alias("sa")).join(classes.select("rep", "regs"), "rep")
    b = sets.select(F.col("rep").alias("main"), F.col("shingles").alias("sb"))
    names = [f"{name}{k}" for name in ("lacks", "has") for k in range(WORDS)] + [f"v{k}" for k in range(BANDS)]

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            counts, maps = [], []
            for x, y, regs in zip(batch.column("sa"), batch.column("sb"), batch.column("regs")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                own = np.setdiff1d(x, y, assume_unique=True)
                counts.append((len(x), len(y), len(own)))
                maps.append(np.concatenate([bitmap(np.setdiff1d(y, x, assume_unique=True)), bitmap(own), np.frombuffer(regs.as_buffer(), np.int64)]))
            numbers = [pa.array(np.ascontiguousarray(c)) for c in np.column_stack([np.array(counts, np.int64), np.stack(maps)]).T]
            yield pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("main"), *numbers], names=["rep", "main", "size", "main_size", "extra", *names])

    longs = ", ".join(f"{n} long" for n in ("rep", "main", "size", "main_size", "extra", *names))
    return pairs.join(a, "rep").join(b, "main").mapInArrow(run, longs)


def may_link(percent: int):
    """Whether two sets (columns ending in _x and _y, with the same main document) can be as similar as wanted.

    Of the main document they share no more than what neither lacks; beyond it, no more than what is in both
    bitmaps. A bit stands for one shingle at least, so both bounds hold whatever collides.
    """
    c = lambda name, side: F.col(f"{name}_{side}")
    total = lambda f: reduce(lambda n, k: n + k, [F.bit_count(f(k)) for k in range(WORDS)])
    lacking = total(lambda k: c(f"lacks{k}", "x").bitwiseOR(c(f"lacks{k}", "y")))
    own = lambda a, b: c("extra", a) - total(lambda k: c(f"has{k}", a).bitwiseAND(F.bitwise_not(c(f"has{k}", b))))
    inside = F.least(c("size", "x") - c("extra", "x"), c("size", "y") - c("extra", "y"), c("main_size", "x") - lacking)
    coarse = F.least(c("size", "x") - c("extra", "x"), c("size", "y") - c("extra", "y")) + F.least("extra_x", "extra_y")
    fine = inside + F.least(own("x", "y"), own("y", "x"))
    enough = lambda most: 100 * most >= percent * (c("size", "x") + c("size", "y") - most)
    return enough(coarse) & enough(fine)


def first_met() -> Column:
    """Whether two classes (columns ending in _x and _y) share no band before this one, so that a pair is made once."""
    return reduce(lambda a, b: a & b, [(F.col("o.band") <= k) | (F.col(f"v{k}_x") != F.col(f"v{k}_y")) for k in range(BANDS)])


def components(links: DataFrame) -> DataFrame:
    """(node, label): the least node reachable over the links (a, b), for every node that has one.

    Each round hooks every node to its least neighbour, follows the hooks to their end by pointer
    jumping, and keeps only the links between different ends. The least node of a component is always
    its own end, and at most half of the nodes are ends, so the links vanish in few rounds. Nothing is collected.
    """
    links = materialize(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = links.select(F.col("a").alias("node"), F.col("a").alias("label")).where(F.lit(False))
    first = True
    while not links.isEmpty():
        arcs = links.union(links.select(F.col("b"), F.col("a")))
        hooks = materialize(arcs.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("other")).select("node", F.least("node", "other").alias("end")))
        moved = True
        while moved:
            onward = hooks.select(F.col("node").alias("at"), F.col("end").alias("next"))
            jumped = materialize(hooks.join(onward, hooks["end"] == onward["at"]).select("node", F.col("end").alias("old"), F.col("next").alias("end")))
            hooks = jumped.select("node", "end")
            moved = not jumped.where("old <> end").isEmpty()
        if first:
            labels, first = hooks.select("node", F.col("end").alias("label")), False
        else:
            onward = hooks.select(F.col("node").alias("at"), F.col("end").alias("next"))
            labels = materialize(labels.join(onward, labels["label"] == onward["at"], "left").select("node", F.coalesce("next", "label").alias("label")))
        ends_a = hooks.select(F.col("node").alias("a"), F.col("end").alias("end_a"))
        ends_b = hooks.select(F.col("node").alias("b"), F.col("end").alias("end_b"))
        across = links.join(ends_a, "a").join(ends_b, "b").where("end_a <> end_b")
        links = materialize(across.select(F.least("end_a", "end_b").alias("a"), F.greatest("end_a", "end_b").alias("b")).distinct())
    return labels


def label_of(rows: DataFrame, node: str, labels: DataFrame) -> DataFrame:
    """``rows`` with each ``node`` replaced by its label, where it has one."""
    known = labels.select(F.col("node").alias("_node"), F.col("label").alias("_label"))
    return rows.join(known, rows[node] == known["_node"], "left").drop("_node").withColumn(node, F.coalesce("_label", node)).drop("_label")


def judged(docs: DataFrame, id_col: str, text_col: str, shingle: int, percent: int) -> DataFrame:
    """(_id, _key, n_shingles, component) of every row; _key is a hash of its text, which tells rows of one id apart."""
    ship_package(docs.sparkSession)
    text = docs[text_col].cast("string")
    rows = docs.select(docs[id_col].alias("_id"), F.xxhash64(text).alias("_key"), text.alias("_text"))
    sketched = materialize(sketch(rows, shingle))
    # A class is named by its least row that has an id, and numbered once it is written.
    named = F.when(F.col("_id").isNotNull(), F.struct("_id", "_key"))
    classes = sketched.where("n_shingles > 0").groupBy("digest").agg(F.min(named).alias("of"), F.first("n_shingles").alias("n_shingles"), F.first("regs").alias("regs")).where("of is not null")
    classes = materialize(classes.withColumn("rep", F.monotonically_increasing_id()))
    bands = band_rows(classes)
    buckets = materialize(bands.groupBy("band", "value").agg(F.min("rep").alias("lead"), F.max("rep").alias("last")).where("lead <> last").select("band", "value", "lead"))
    members = materialize(bands.join(buckets, ["band", "value"]))
    pairs = members.where("rep <> lead").select(F.col("lead").alias("a"), F.col("rep").alias("b"))
    tried = materialize(pairs.distinct())
    # Sets only of classes that share a bucket with another one, from one row of each.
    wanted = members.select("rep").distinct().join(classes, "rep").select("rep", F.col("of._id").alias("_of"), F.col("of._key").alias("_of_key"))
    again = not sketched.groupBy("_id", "_key").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    single = rows.dropDuplicates(["_id", "_key"]) if again else rows
    near = single.join(maybe_broadcast(wanted), (F.col("_id") == F.col("_of")) & (F.col("_key") == F.col("_of_key"))).select("rep", "_text")

    def to_sets(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingle_set(t.as_py(), shingle).tobytes() for t in batch.column(1)], pa.binary())], names=["rep", "shingles"])

    sets = materialize(near.mapInArrow(to_sets, "rep long, shingles binary"))
    links = materialize(_exact(_likely(tried, classes, percent / 100), sets, percent))
    labels = components(links)
    # Buckets that still hold several components: whoever is outside the largest one meets all the others.
    tagged = members.select("rep", "band", "value").join(labels, members["rep"] == labels["node"], "left").select("rep", "band", "value", F.coalesce("label", "rep").alias("label"))
    sizes = tagged.groupBy("band", "value", "label").agg(F.count("*").alias("n"))
    main = sizes.groupBy("band", "value").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.count("*").alias("parts")).where("parts > 1").select("band", "value", "main")
    open_rows = materialize(tagged.join(main, ["band", "value"]))
    sized = materialize(open_rows.join(against_main(open_rows.select("rep", "main").distinct(), sets, classes), ["rep", "main"]))
    side = lambda p: [F.col(c).alias(c + p) for c in sized.columns if c not in ("band", "value")]
    outside = sized.where("label <> main").select("band", "value", *side("_x"))
    inside = sized.select("band", "value", *side("_y"))
    # Decided within the join, so that only pairs that may be links become rows; each in one bucket and one order.
    # Two classes of different labels are in any bucket that they share, and what rules them out in one of these holds in all.
    once = (F.col("label_y") == F.col("main_y")) | (F.col("rep_x") < F.col("rep_y"))
    possible = (F.col("label_x") != F.col("label_y")) & once & may_link(percent) & first_met()
    same = (F.col("o.band") == F.col("i.band")) & (F.col("o.value") == F.col("i.value"))
    rest = outside.alias("o").join(inside.alias("i"), same & possible).select(F.least("rep_x", "rep_y").alias("a"), F.greatest("rep_x", "rep_y").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")
    rest = materialize(rest)
    found = label_of(classes.select("digest", F.col("of._id").alias("_least"), F.col("rep").alias("_component")), "_component", labels)
    if not rest.isEmpty():
        more = materialize(_exact(_likely(rest, classes, percent / 100), sets, percent))
        if not more.isEmpty():  # these link components: only their labels are looked at again
            found = label_of(found, "_component", components(label_of(label_of(more, "a", labels), "b", labels)))
    least = found.groupBy("_component").agg(F.min("_least").alias("component"))
    named = found.join(least, "_component").select("digest", "component")
    out = sketched.select("_id", "_key", "n_shingles", "digest").join(named, "digest", "left")
    return out.select("_id", "_key", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("_id")).alias("component"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """id, n_shingles, component_id (least id of the component) and kept (the id is that one), for every row.

    Links join texts whose sets of ``shingle``-word shingles have a Jaccard similarity of ``percent``
    hundredths or more. A text of fewer words is one shingle; null and blank texts have none, link
    with nothing and are kept. Rows that share an id are judged each by its own text. Rows with a null id get the
    component of their text's class, or none, and then are kept. Empty tables give no rows. Other columns are not read.
    """
    out = judged(docs, id_col, text_col, shingle, percent)
    return out.select(F.col("_id").alias(id_col), "n_shingles", F.col("component").alias("component_id"), F.col("_id").eqNullSafe(F.col("component")).alias("kept"))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """The documents without those that are near copies of one with a smaller id; columns as they came.

    A row goes by its id and its text, so another text under the same id stays. Null and blank texts stay, and
    so do rows with a null id unless their text's component has an id. Rows that share id and text are one document. No rows give none.
    """
    gone = judged(docs, id_col, text_col, shingle, percent).where(~F.col("_id").eqNullSafe(F.col("component"))).select(F.col("_id").alias("_penumbra_gone"), F.col("_key").alias("_penumbra_key")).distinct()
    return docs.join(gone, docs[id_col].eqNullSafe(gone["_penumbra_gone"]) & (F.xxhash64(docs[text_col].cast("string")) == gone["_penumbra_key"]), "left_anti")
