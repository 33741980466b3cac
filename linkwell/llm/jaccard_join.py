"""Exact Jaccard self-join of texts by parity sketches.

Each text's set of k-word shingles is hashed; every shingle flips one bit of a parity sketch, so the
Hamming distance of two sketches is never more than the symmetric difference of their sets. A
Jaccard similarity of num/den or more bounds that difference by (den - num) / (den + num) of the
two sizes' sum. Within a size band the largest bound is one number D, and a sketch cut into D + 1
segments must agree in one segment at least: equal segments are the join key (pigeonhole). A text
whose own bound is smaller agrees with its partners in more segments than one and leaves out the
poorest ones, so segments with few shingles, which unlike texts share by chance, are rarely keys.

A text that is equal to another as a set shares its class, so copies never form pairs. The texts
that share a key are a group. Within a group whole sketches and sizes are compared, and of the pairs
that pass only as many are emitted as connect their members; these are verified on the sets. Where
verified links leave the members of such a cluster in several components, sets of different
components are compared in blocks, and only verified links that connect are emitted. A pair that
links passes every test on the way, so no link between components is lost, and no step emits more
pairs than connect its members. Groups and clusters above a size are dealt into blocks: members that
are connected already (to the group's hub, or in the largest component) meet the others, never each
other.

Cases: a null or wordless text has the empty set, n_shingles 0 and links with nothing; a text with
fewer than k words has one shingle, the whole sequence; rows with the same id are one node; a null
id gives a null component_id and takes no part; extra columns are ignored; an empty table gives an
empty result; a text of any length is one set.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, maybe_among, runs, stage, unstage, utf8
from .components import components
from .textkit import U, lower_ascii, mix, shingle_hashes, word_bounds, word_hashes

GROWTH = 2  # of the size bands
CHUNK = 2048  # members of a group that one side of a block of sketch comparisons holds
WEIGHT = 1 << 18  # shingles that one side of a block of set comparisons holds


class Bands:
    """Size bands, their bounds on the symmetric difference and their numbers of segments."""

    def __init__(self, num: int, den: int, most: int = 1 << 40):
        self.num, self.den = num, den
        tops = [0]
        while tops[-1] < most:
            tops.append(max(math.ceil(tops[-1] * GROWTH), tops[-1] + 6))
        self.tops = np.array(tops, np.int64)
        self.diff = np.array([2 * t * (den - num) // (den + num) for t in tops[1:]], np.int64)
        self.segments = np.where(self.diff > 0, self.diff + 1, 0)
        self.width = np.array([1 << max(6, int(16 * (d + 1)).bit_length() - 1) for d in self.diff], object)

    def of(self, n: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.tops, n) - 1

    def also_next(self, n: np.ndarray) -> np.ndarray:
        """Whether a set of n may link with one of the next band."""
        return self.den * n >= self.num * (self.tops[self.of(n) + 1] + 1)

    def left_out(self, n: np.ndarray, band: np.ndarray) -> np.ndarray:
        """Segments that a set of n need not post in a band: one less than it shares with any partner there."""
        largest = np.minimum(n * self.den // self.num, self.tops[band + 1])
        return self.segments[band] - 1 - (n + largest) * (self.den - self.num) // (self.den + self.num)


def _sets(column: pa.Array, k: int):
    """Distinct sorted shingle hashes of each text, as (values, first index of each text)."""
    buf, off = utf8(column)
    buf = lower_ascii(buf)
    starts, ends, first = word_bounds(buf, off)
    hashes, ptr = shingle_hashes(word_hashes(buf, starts, ends), first, k)
    owner = np.repeat(np.arange(len(off) - 1), np.diff(ptr))
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    keep = np.ones(len(hashes), bool)
    keep[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    hashes, owner = hashes[keep], owner[keep]
    return hashes, owner, np.searchsorted(owner, np.arange(len(off)))


def _prints(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit fingerprints of each set; 0 for the empty one."""
    out = []
    for salt in (0x3C6EF372FE94F82B, 0xDAA66D2C7DDF743F):
        sums = np.concatenate((np.zeros(1, U), np.cumsum(mix(hashes ^ U(salt)), dtype=U)))
        out.append((sums[first[1:]] - sums[first[:-1]]).view(np.int64))
    return out[0], out[1]


def _segment_keys(hashes, owner, first, bands: Bands):
    """(text, key) of the segments that each text posts, in its own band and where it may link in the next.

    The ones left out are the least in an order by content: number of shingles, then key. Of the
    segments that two linked texts share, the greatest has so many shared ones below it that neither leaves it out.
    """
    n = np.diff(first)
    own = np.maximum(bands.of(n), 0)
    texts, keys = [], []
    value, place = mix(hashes ^ U(0x5851F42D4C957F2D)), (hashes >> U(32)).astype(np.int64)
    for step, use in ((0, n > 0), (1, (n > 0) & bands.also_next(np.maximum(n, 1)))):
        band = own + step
        segments = np.where(use, bands.segments[band], 0)
        base = np.concatenate(([0], np.cumsum(segments)))
        if not base[-1]:
            continue
        hold = segments[owner] > 0
        at = base[owner[hold]] + ((place[hold] * segments[owner[hold]]) >> 32)
        acc = np.zeros(int(base[-1]), U)
        np.bitwise_xor.at(acc, at, value[hold])
        count = np.bincount(at, minlength=len(acc))
        text = np.repeat(np.arange(len(n)), segments)
        index = np.arange(len(acc)) - base[text]
        key = mix(acc ^ mix((band[text].astype(U) << U(40)) + index.astype(U) + U(1)))
        rank = np.empty(len(acc), np.int64)
        rank[np.lexsort((key, count, text))] = np.arange(len(acc))
        emit = rank - base[text] >= bands.left_out(n, band)[text]
        texts.append(text[emit])
        keys.append(key[emit])
    if not texts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(texts), np.concatenate(keys).view(np.int64)


def _sketch(hashes: np.ndarray, width: int) -> bytes:
    """The parity sketch of a set: bit i is the parity of the shingles that fall on i."""
    at = (mix(hashes ^ U(0x27BB2EE687B0B0FD)) & U(width - 1)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=width).astype(np.uint8) & 1, bitorder="little").tobytes()


def _signatures(docs: DataFrame, k: int, bands: Bands) -> DataFrame:
    def run(batches):
        for batch in batches:
            for at, count in byte_slices(batch.column(1)):
                part = batch.slice(at, count)
                hashes, _, first = _sets(part.column(1), k)
                one, two = _prints(hashes, first)
                n = np.diff(first)
                own = np.maximum(bands.of(n), 0)
                sketches = [_sketch(hashes[a:b], bands.width[w]) if b > a else None for a, b, w in zip(first[:-1], first[1:], own, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n), pa.array(one), pa.array(two), pa.array(sketches, pa.binary())],
                    ["id", "n", "f1", "f2", "sketch"],
                )

    return docs.mapInArrow(run, "id bigint, n bigint, f1 bigint, f2 bigint, sketch binary")


def _postings(docs: DataFrame, k: int, bands: Bands) -> DataFrame:
    def run(batches):
        seen: dict[int, None] = {}
        for batch in batches:
            for at, count in byte_slices(batch.column(1)):
                hashes, owner, first = _sets(batch.column(1).slice(at, count), k)
                one, _ = _prints(hashes, first)
                fresh = np.zeros(len(one), bool)  # the first of copies that are near in the table speaks for them
                for i, f in enumerate(one.tolist()):
                    if f not in seen:
                        seen[f] = None
                        fresh[i] = True
                if len(seen) > 200_000:
                    seen.clear()
                hold = fresh[owner]
                hashes, owner = hashes[hold], owner[hold]
                text, keys = _segment_keys(hashes, owner, np.searchsorted(owner, np.arange(len(one) + 1)), bands)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(one[text])], ["key", "f1"])

    return docs.mapInArrow(run, "key bigint, f1 bigint")


def _hashed_sets(docs: DataFrame, k: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for at, count in byte_slices(batch.column(1)):
                part = batch.slice(at, count)
                hashes, _, first = _sets(part.column(1), k)
                one, two = _prints(hashes, first)
                sets = [hashes[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(one), pa.array(two), pa.array(np.diff(first)), pa.array(sets, pa.binary())], ["id", "f1", "f2", "n", "shingles"]
                )

    return docs.mapInArrow(run, "id bigint, f1 bigint, f2 bigint, n bigint, shingles binary")


def _near(n: np.ndarray, rows: np.ndarray, r: int, at: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Of members `at` those whose sizes and sketches allow a link with member r, and the sketches' distances."""
    at = at[den * np.minimum(n[at], n[r]) >= num * np.maximum(n[at], n[r])]
    far = np.bitwise_count(rows[at] ^ rows[r]).sum(axis=1, dtype=np.int64)
    hold = far <= (n[at] + n[r]) * (den - num) // (den + num)
    return at[hold], far[hold]


def _folded(sketch: bytes, size: int) -> np.ndarray:
    """A sketch folded by XOR to size bytes, as words."""
    x = np.frombuffer(sketch, U)
    while 8 * len(x) > size:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def _partners(block: dict, label: np.ndarray, r: int) -> np.ndarray:
    """Members after r that r is to be compared with in this block and that are not yet connected to it."""
    ok = label[r + 1 :] != label[r]
    if block["kind"][0]:  # one side holds main members, the other side the rest
        ok &= block["main"][r + 1 :] != block["main"][r]
    elif block["i"][0] != block["j"][0]:  # two chunks of the rest; pairs within a chunk belong to its own block
        ok &= block["part"][r + 1 :] != block["part"][r]
    return np.flatnonzero(ok) + r + 1


def _forest(label: np.ndarray, found) -> list[tuple[int, int]]:
    """Pairs that connect a block's members; found(r, label) gives the members linked with r, nearest first."""
    out = []
    for r in range(len(label) - 1):
        at = found(r, label)
        if len(at):
            roots, first = np.unique(label[at], return_index=True)
            out += [(r, int(x)) for x in at[first]]
            label[np.isin(label, roots)] = label[r]
    return out


def _near_block(block: dict, num: int, den: int) -> list[tuple[int, int]]:
    n, sketches = block["n"], block["payload"]
    size = min(map(len, sketches))
    rows = np.stack([_folded(x, size) for x in sketches])

    def found(r: int, label: np.ndarray) -> np.ndarray:
        at, far = _near(n, rows, r, _partners(block, label, r), num, den)
        return at[np.argsort(far, kind="stable")]

    return _forest(np.where(block["main"], -1, np.arange(len(n))), found)


def _link_block(block: dict, num: int, den: int) -> list[tuple[int, int]]:
    n = block["n"]
    sets = [np.frombuffer(x, U) for x in block["payload"]]
    shared, items = np.unique(np.concatenate(sets), return_inverse=True)
    first = np.concatenate(([0], np.cumsum([len(x) for x in sets])))
    mark = np.zeros(len(shared), bool)

    def found(r: int, label: np.ndarray) -> np.ndarray:
        at = _partners(block, label, r)
        at = at[den * np.minimum(n[at], n[r]) >= num * np.maximum(n[at], n[r])]
        if not len(at):
            return at
        own = items[first[r] : first[r + 1]]
        mark[own] = True
        if 4 * len(at) < len(n):
            inter = np.array([mark[items[first[x] : first[x + 1]]].sum() for x in at])
        else:
            inter = np.add.reduceat(mark[items], first[:-1], dtype=np.int64)[at]
        mark[own] = False
        return at[den * inter >= num * (n[at] + n[r] - inter)]

    return _forest(np.unique(block["comp"], return_inverse=True)[1], found)


BLOCK = "key bigint, kind boolean, i int, j int, part int, id bigint, main boolean, n bigint, comp bigint, payload binary"


def _compared(blocks: DataFrame, kernel, num: int, den: int) -> DataFrame:
    """(a, b) of the pairs that kernel gives for each block; blocks has the columns of BLOCK."""
    names = [c.split()[0] for c in BLOCK.split(", ")]
    blocks = blocks.select(*names).repartition("key", "kind", "i", "j").sortWithinPartitions("key", "kind", "i", "j", "id")

    def run(batches):
        for table, bounds in runs(batches, ("key", "kind", "i", "j")):
            out = []
            columns = {c: np.asarray(table.column(c)) for c in names[1:-1]}
            for s, e in zip(bounds[:-1], bounds[1:], strict=True):
                if e - s > 1:
                    block = {c: x[s:e] for c, x in columns.items()}
                    block["payload"] = [x.as_py() for x in table.column("payload").slice(s, e - s)]
                    out += [(int(block["id"][a]), int(block["id"][b])) for a, b in kernel(block, num, den)]
            a, b = zip(*out, strict=True) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return blocks.mapInArrow(run, "a bigint, b bigint").filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _dealt(rows: DataFrame, weight: Column, most: int) -> DataFrame:
    """rows (key, id, main, ...) dealt into blocks of comparisons: of main members with the rest, and of the rest among itself.

    Main members are connected already and are not compared with each other. A side of a block holds
    chunks of a weight of about `most`.
    """
    share = lambda c: F.ceil(F.coalesce(F.sum(F.when(c, weight)), F.lit(0)) / most).cast("int")
    parts = stage(rows.groupBy("key").agg(share(F.col("main")).alias("mains"), share(~F.col("main")).alias("others")).filter("others > 0"), "parts")
    rows = rows.join(parts, "key").withColumn("part", F.pmod(F.xxhash64("id"), F.when(F.col("main"), F.col("mains")).otherwise(F.col("others"))).cast("int"))
    up_to = lambda c: F.when(F.col(c) > 0, F.sequence(F.lit(0), F.col(c) - 1)).otherwise(F.array().cast("array<int>"))
    place = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"))
    part = F.col("part")
    across = F.transform(up_to("others"), lambda o: place(True, part, o))
    back = F.transform(up_to("mains"), lambda m: place(True, m, part))
    among = F.transform(up_to("others"), lambda o: place(False, F.least(part, o), F.greatest(part, o)))
    return rows.withColumn("at", F.explode(F.when(F.col("main"), across).otherwise(F.concat(back, among)))).select("*", "at.kind", "at.i", "at.j").drop("at")


def _near_pairs(members: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b): pairs of one group whose sizes and sketches allow a link, as many as connect all such members of the group."""
    groups = _unlike(members)
    rows = groups.join(classes.select("f1", F.col("rep").alias("id"), "n", F.col("sketch").alias("payload")), "f1")
    rows = stage(rows.select("key", "id", "n", "payload", "size", (F.col("f1") == F.col("hub")).alias("is_hub"), F.lit(0).cast("bigint").alias("comp")), "groups")
    alone = {"kind": F.lit(False), "i": F.lit(0), "j": F.lit(0), "part": F.lit(0), "main": F.lit(False)}
    small = _compared(rows.filter(F.col("size") <= CHUNK).withColumns(alone), _near_block, num, den)
    large = rows.filter(F.col("size") > CHUNK)
    if large.isEmpty():
        return small
    hubs = stage(large.filter("is_hub").select("key", F.col("id").alias("hub_id"), F.col("n").alias("hub_n"), F.col("payload").alias("hub_payload")), "hubs")

    def run(batches):
        for batch in batches:
            kept = []
            for n, mine, hub_n, hub in zip(*(batch.column(c).to_pylist() for c in ("n", "payload", "hub_n", "hub_payload")), strict=True):
                sketches = [_folded(x, min(len(mine), len(hub))) for x in (mine, hub)]
                kept.append(bool(len(_near(np.array([n, hub_n]), np.stack(sketches), 1, np.array([0]), num, den)[0])))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "id", "hub_id", "n", "comp", "payload")), pa.array(kept, pa.bool_())], ["key", "id", "hub_id", "n", "comp", "payload", "main"])

    tested = large.join(hubs, "key").mapInArrow(run, "key bigint, id bigint, hub_id bigint, n bigint, comp bigint, payload binary, main boolean")
    tested = stage(tested, "tested")
    star = tested.filter("main and id <> hub_id").select(F.least("id", "hub_id").alias("a"), F.greatest("id", "hub_id").alias("b"))
    return small.union(star).union(_compared(_dealt(tested, F.lit(1), CHUNK), _near_block, num, den)).distinct()


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Of (a, b) the pairs that link."""

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), U) for v in (x, y))
                inter = len(x) + len(y) - len(np.union1d(x, y))
                keep.append(den * inter >= num * (len(x) + len(y) - inter))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])

    side = lambda x: sets.select(F.col("id").alias(x), F.col("shingles").alias(f"set_{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "set_a", "set_b").mapInArrow(run, "a bigint, b bigint")


def _sets_of(docs: DataFrame, near: DataFrame, classes: DataFrame, k: int) -> DataFrame:
    """(id, n, shingles) of the classes that stand in near, read again from the texts concerned."""
    wanted = near.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    some = maybe_among(docs, "id", wanted, "among").filter("among").drop("among")  # texts that surely are none are not shuffled
    sets = _hashed_sets(some.join(wanted, "id", "left_semi"), k)
    whole = sets.join(classes.select("f1", "f2", F.col("rep").alias("id")), ["id", "f1", "f2"], "left_semi")
    return stage(whole.dropDuplicates(["id", "f1", "f2"]).select("id", "n", "shingles"), "sets")


def _across(comp: DataFrame, clusters: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) between members of one cluster and different components, as many as connect them.

    comp: (id, comp) of every member; clusters: (comp, key).
    """
    weight = sets.groupBy("id").agg(F.sum("n").alias("weight"))
    rows = stage(comp.join(clusters, "comp").join(weight, "id").select("key", "id", "comp", "weight"), "clusters")
    each = rows.groupBy("key", "comp").agg(F.sum("weight").alias("weight"))
    best = stage(each.groupBy("key").agg(F.max(F.struct("weight", "comp"))["comp"].alias("best")), "best")
    rows = rows.join(best, "key").withColumn("main", F.col("comp") == F.col("best")).drop("best")
    blocks = _dealt(rows, F.col("weight"), WEIGHT).join(sets.withColumnRenamed("shingles", "payload"), "id")
    return _compared(blocks, _link_block, num, den)


def _labels(near: DataFrame, docs: DataFrame, classes: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(id, component_id) of every class that stands in near: verified links, then links across the components they leave."""
    sets = _sets_of(docs, near, classes, k)
    links = stage(_verified(near, sets, num, den), "links")
    ids = near.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    comp = stage(ids.join(components(links, "a", "b"), "id", "left").select("id", F.coalesce("component_id", "id").alias("comp")), "comp")
    side = lambda x: comp.select(F.col("id").alias(x), F.col("comp").alias(f"comp_{x}"))
    joined = lambda pairs: pairs.join(side("a"), "a").join(side("b"), "b").filter("comp_a <> comp_b").select("comp_a", "comp_b").distinct()
    loose = stage(joined(near), "loose")
    if not loose.isEmpty():
        clusters = components(loose, "comp_a", "comp_b").select(F.col("id").alias("comp"), F.col("component_id").alias("key"))
        more = stage(_across(comp, clusters, sets, num, den), "more")
        if not more.isEmpty():
            merged = components(joined(more), "comp_a", "comp_b").select(F.col("id").alias("comp"), "component_id")
            comp = stage(comp.join(merged, "comp", "left").select("id", F.coalesce("component_id", "comp").alias("comp")), "comp")
    for used in (sets, links):
        unstage(used)
    return comp.select("id", F.col("comp").alias("component_id"))


def _unlike(members: DataFrame) -> DataFrame:
    """(key, f1) with size and hub, its group's number of members and least one; of groups with the same members one remains."""
    size = members.groupBy("key").agg(
        F.count("*").alias("size"), F.sum(F.xxhash64("f1").cast("decimal(20,0)")).alias("s1"), F.sum(F.xxhash64(F.lit(1), "f1").cast("decimal(20,0)")).alias("s2"), F.min("f1").alias("hub")
    )
    one = size.groupBy("size", "s1", "s2").agg(F.min("key").alias("key"), F.first("hub").alias("hub"))
    return members.join(stage(one.select("key", "hub", "size"), "unlike"), "key").select("key", "f1", "hub", "size")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(id_col, n_shingles, component_id) for every row of docs; texts link at a Jaccard similarity of num/den."""
    bands = Bands(num, den)
    docs = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    known = docs.filter("id is not null and text is not null")
    signed = stage(_signatures(docs, k, bands), "signed")
    classes = stage(
        signed.filter("id is not null and n > 0").groupBy("f1", "f2", "n").agg(F.min("id").alias("rep"), F.first("sketch").alias("sketch")), "classes"
    )
    postings = _postings(known, k, bands)
    shared = postings.groupBy("key").agg(F.min("f1").alias("low"), F.max("f1").alias("high")).filter("low < high")
    members = stage(postings.join(shared.select("key"), "key").distinct(), "members")
    near = stage(_near_pairs(members, classes, num, den), "near")
    unstage(members)
    out = signed.join(classes.select("f1", "f2", "n", "rep"), ["f1", "f2", "n"], "left")
    if near.isEmpty():
        out = out.withColumn("component_id", F.lit(None).cast("bigint"))
    else:
        labels = _labels(near, known, classes, k, num, den)
        out = out.join(labels.select(F.col("id").alias("rep"), "component_id"), "rep", "left")
    return out.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.when(F.col("id").isNotNull(), F.coalesce("component_id", F.when(F.col("n") > 0, F.col("rep")), "id")).alias("component_id"),
    )
