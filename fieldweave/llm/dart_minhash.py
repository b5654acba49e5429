"""Near-duplicate documents by DartMinHash signatures and banded joins.

A document is a weighted set of word shingles. Hashed darts are thrown at each element: in each weight
region [0, 1), [1, 2), [2, 4), ... of the element they form one random sequence of ranks, weights and
coordinates that depends on the element and region alone. A dart counts if its weight is below the
element's; of each coordinate the earliest dart is kept. Two sets agree in a coordinate with a probability
of their weighted Jaccard similarity. The ranks looked at shrink with the total weight, so a set costs one
pass over its elements and about k log k darts.

Documents of equal shingles are one representative. Signatures are cut into bands; representatives that
agree in a band meet in a bucket. First one member of each bucket is compared with the others, exactly,
over complete shingle sets, and links make classes; where a bucket still has several, another one is.
Then, in each bucket that still has several classes, all members outside of its largest class are compared
with all others of other classes: in blocks, over sketches (two bits of each coordinate of a longer
signature, which only these members get), each pair in the first band it shares and nowhere else. Where
these don't rule a pair out by a wide margin, the block gets the complete sets, and gives no more links than
join its classes. So no pair that shares a band is left out but where a link is known already, no pairs of
a bucket become rows but those links, and no task gets more than a block of a bucket.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared
from .text_kernel import U, distinct, mix, shingles, steps, text_slices, words


@dataclass(frozen=True)
class NearOptions:
    """A pair of similarity 0.8 shares no band with a probability of (1 - 0.8^rows)^bands: 5e-8 here."""

    words: int = 5
    similarity: float = 0.8
    bands: int = 32
    rows: int = 4
    weights: str = "set"  # or "counts": shingles weigh as often as they occur
    sketch: int = 512
    doubt: float = 4.5  # standard errors below the similarity at which sketches rule a pair out
    strays: int = 256  # askers of a block, about
    members: int = 2048  # members of a block, about
    most_broadcast: int = 4_000_000  # ids that may be broadcast, 8 bytes each


def _uniform(x: np.ndarray) -> np.ndarray:
    """In (0, 1)."""
    return ((x >> U(11)).astype(np.float64) + 0.5) * 2.0**-53


def signatures(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n_docs: int, k: int) -> np.ndarray:
    """The k earliest darts of each set, as hashes; doc is sorted, each (doc, element) occurs once. A set without elements has zeros."""
    out = np.zeros((n_docs, k), U)
    total = np.bincount(doc, weights=weight, minlength=n_docs)
    regions = 1 + np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64)
    row = np.repeat(np.arange(len(element)), regions)
    region = np.arange(len(row)) - np.repeat(np.cumsum(regions) - regions, regions)
    low = np.where(region > 0, 2.0 ** (region - 1.0), 0.0)
    width = np.where(region > 0, low, 1.0)
    seed = mix(element[row] + steps(4, 64)[region])
    top, own = weight[row], doc[row]
    reach = (k * np.log(k) + 2 * k) / np.maximum(total, 1e-12)
    todo = total > 0
    coordinate_step, weight_step, gap_step = steps(5, 3)
    while todo.any():
        live = np.flatnonzero(todo[own])
        rank, dart = np.zeros(len(live)), seed[live]
        docs, coords, ranks, names = [], [], [], []
        while len(live):
            dart = mix(dart + gap_step)
            rank = rank - np.log(_uniform(dart)) / width[live]
            keep = rank < reach[own[live]]
            live, rank, dart = live[keep], rank[keep], dart[keep]
            hit = low[live] + width[live] * _uniform(mix(dart + weight_step)) < top[live]
            docs.append(own[live][hit])
            coords.append((mix(dart[hit] + coordinate_step) >> U(32)).astype(np.int64) * k >> 32)
            ranks.append(rank[hit])
            names.append(dart[hit])
        order = np.argsort(np.concatenate(ranks))[::-1]
        at = np.concatenate(docs)[order] * k + np.concatenate(coords)[order]
        first = np.zeros(n_docs * k, U)
        first[at] = np.concatenate(names)[order]  # the earliest is assigned last
        full = np.zeros(n_docs * k, bool)
        full[at] = True
        done = todo & full.reshape(n_docs, k).all(axis=1)
        out[done] = first.reshape(n_docs, k)[done]
        todo &= ~done
        reach[todo] *= 2
    return out


def elements(column: pa.Array, options: NearOptions) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(doc, element, count) of the shingles of each text, sorted by doc; a text of fewer words is one shingle of all of them."""
    w = words(column)
    h = w.hashes()
    value, at = shingles(w, options.words, h)
    doc = w.doc[at]
    n = np.diff(w.bounds)
    short = np.flatnonzero((n > 0) & (n < options.words))
    if len(short):
        place = np.arange(len(h)) - w.bounds[w.doc]
        part = np.flatnonzero(n[w.doc] < options.words)
        key = np.zeros(w.n_docs, U)
        np.add.at(key, w.doc[part], mix(h[part] + steps(6, options.words)[place[part]]))
        doc, value = np.concatenate([doc, short]), np.concatenate([value, mix(key[short])])
    doc, value, count = distinct(doc, value)
    return doc, value, count, w.n_docs


FEATURES = "doc_id long, set_a long, set_b long, n_shingles int, bands array<long>"


def _features(options: NearOptions):
    k = options.bands * options.rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                doc, value, count, n = elements(part.column("text"), options)
                weight = np.ones(len(value)) if options.weights == "set" else count.astype(float)
                sig = signatures(doc, value, weight, n, k).reshape(n, options.bands, options.rows)
                band = np.zeros((n, options.bands), U)
                for i, factor in enumerate(steps(7, options.rows) | U(1)):
                    band += mix(sig[:, :, i]) * factor
                band = mix(band + steps(8, options.bands))
                sums = np.zeros((2, n), U)
                for s, seed in zip(sums, steps(9, 2)):
                    np.add.at(s, doc, mix(value + seed) * (count.astype(U) if options.weights != "set" else U(1)))
                bands = pa.ListArray.from_arrays(pa.array(np.arange(0, n * options.bands + 1, options.bands, dtype=np.int32)), pa.array(band.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)), pa.array(np.bincount(doc, minlength=n).astype(np.int32)), bands], ["doc_id", "set_a", "set_b", "n_shingles", "bands"])

    return run


def _shingle_sets(options: NearOptions):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                doc, value, count, n = elements(part.column("text"), options)
                if options.weights != "set":  # the c-th occurrence of a shingle is an element of its own
                    nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                    doc, value = np.repeat(doc, count), mix(np.repeat(value, count) + mix(nth.astype(U)))
                ends = np.searchsorted(doc, np.arange(n + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(value.view(np.int64)))], ["id", "elements"])

    return run


def _sketches(options: NearOptions, at_once: int = 128):
    """Two bits of each of `sketch` coordinates, as least_agreement() expects them."""
    shift = np.arange(0, 64, 2, dtype=U)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, at_once):
                part = batch.slice(first, at_once)
                lists = part.column("elements")
                size = lists.value_lengths().to_numpy()
                sig = signatures(np.repeat(np.arange(len(size)), size), lists.flatten().to_numpy().view(U), np.ones(int(size.sum())), len(size), options.sketch)
                bits = (((sig >> U(20)) & U(3)).reshape(len(size), -1, 32) << shift).sum(axis=2, dtype=U)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([x.tobytes() for x in bits], pa.binary())], ["id", "sketch"])

    return run


def least_agreement(options: NearOptions) -> float:
    """Coordinates of a sketch that agree, under which a pair is ruled out; a quarter of those that differ agree in two bits."""
    share = (1 + 3 * options.similarity) / 4
    return options.sketch * share - options.doubt * (options.sketch * share * (1 - share)) ** 0.5


#: Edges of a graph whose components one task finds, some 2 MB; larger graphs take rounds of joins.
FEW_EDGES = 100_000


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, label) of all ids of the edges of a small graph, by union-find."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    yield pa.RecordBatch.from_arrays([pa.array(list(up), pa.int64()), pa.array([root(x) for x in up], pa.int64())], ["id", "label"])


def connected(edges: DataFrame, name: str = "components", few: int = FEW_EDGES) -> DataFrame:
    """(id, label): the least id of each component, for all ids that edges (a, b) have. A written table.

    Up to `few` edges one task unites them; else large and small stars alternate until nothing changes. Labels
    are the same both ways.
    """
    spark = edges.sparkSession
    flat = shared.written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), name)
    before = None
    while True:
        state = flat.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        if state[0] <= few:
            labels = shared.written(shared.arrow_map(flat.coalesce(1), _united, "id long, label long"), name)
            shared.dropped(spark, flat)
            return labels
        before = state
        both = flat.union(flat.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # Each node links its larger neighbours to the least of them and itself, then its smaller ones.
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        after = shared.written(small, name)
        shared.dropped(spark, flat)
        flat = after
    stars = flat.select(F.col("a").alias("id"), F.col("b").alias("label"))
    labels = shared.written(stars.union(flat.select(F.col("b").alias("id"), F.col("b").alias("label")).distinct()), name)
    shared.dropped(spark, flat)
    return labels


def _needed(sets: DataFrame, ids: DataFrame, options: NearOptions) -> DataFrame:
    """The sets of these ids: while the ids are few they go to the sets, so that no others are shuffled."""
    return sets.join(shared.bounded(ids.distinct(), options.most_broadcast), "id", "left_semi")


def _linked(tables: shared.Scratch, pairs: DataFrame, sets: DataFrame, sizes: DataFrame, options: NearOptions) -> DataFrame:
    """Of the pairs (a, b), those of the similarity or more. A leader's set goes to as many places as its pairs need."""
    similarity = options.similarity
    # The sizes alone rule many pairs out before any set moves; of rows that share an id, all sizes are tried.
    a, b = (sizes.select(F.col("id").alias(x), F.col("least").alias(f"{x}_least"), F.col("most").alias(f"{x}_most")) for x in "ab")
    may = (F.col("a_most") >= similarity * F.col("b_least")) & (F.col("b_most") >= similarity * F.col("a_least"))
    pairs = tables.written(pairs.join(a, "a").join(b, "b").filter(may).select("a", "b"), "near_pairs")
    crowd = tables.written(pairs.groupBy("a").agg(F.ceil(F.count("*") / 64).cast("int").alias("places")), "near_leaders")
    left = sets.join(shared.bounded(crowd, options.most_broadcast), F.col("id") == F.col("a")).select("a", F.explode(F.sequence(F.lit(0), F.col("places") - 1)).alias("place"), F.col("elements").alias("x"))
    dealt = pairs.join(crowd, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("places")).cast("int").alias("place"))
    others = _needed(sets, pairs.select(F.col("b").alias("id")), options)
    both = dealt.join(others.select(F.col("id").alias("b"), F.col("elements").alias("y")), "b").join(left, ["a", "place"])
    fits = F.least(F.size("x"), F.size("y")) >= similarity * F.greatest(F.size("x"), F.size("y"))
    common = F.size(F.array_intersect("x", "y"))
    return both.filter(fits).filter(common >= F.lit(similarity) * (F.size("x") + F.size("y") - common) - 1e-9).select("a", "b")


def _led(buckets: DataFrame, order: Column, labels: DataFrame | None = None) -> DataFrame:
    """(a, b): each bucket's first member in that order with the others; if there are labels, with those of another one."""
    rows = buckets.select("band", "key", "id")
    if labels is not None:
        rows = rows.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    else:
        rows = rows.withColumn("label", F.col("id"))
    lead = rows.groupBy("band", "key").agg(F.min(F.struct(order.alias("o"), "id", "label")).alias("lead"))
    pairs = rows.join(lead, ["band", "key"]).filter(F.col("label") != F.col("lead.label")).select(F.col("lead.id").alias("a"), "id")
    return pairs.select(F.least("a", "id").alias("a"), F.greatest("a", "id").alias("b")).distinct()


PLACE = ["key", "band", "sb", "mb"]
LISTED = "key long, band int, sb int, mb int, rank int, id long, label long, others array<long>"


def _by_place(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each place, which stand together, as one table."""
    held = None
    for batch in rows:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        new = np.zeros(held.num_rows, bool)
        for c in PLACE:
            column = held.column(c).to_numpy()
            new[1:] |= column[1:] != column[:-1]
        at = [0, *np.flatnonzero(new).tolist()]
        for x, y in zip(at, at[1:]):
            yield held.slice(x, y - x)
        held = held.slice(at[-1])
    if held is not None and held.num_rows:
        yield held


def _stray_lists(tables: shared.Scratch, buckets: DataFrame, labels: DataFrame, reps: DataFrame, sets: DataFrame, options: NearOptions) -> DataFrame:
    """LISTED rows of the pairs that sketches don't rule out, in the block of a bucket where they meet.

    A member outside of its bucket's largest class asks; it meets all members of other classes. A bucket's
    askers and members are dealt into blocks of a bounded size each, and each block of the one meets each
    block of the other. In each block, an asker's row (rank -1) lists the ids of similar members, and each
    of these has a row of its own; rows of a lower rank are more similar.
    """
    known = buckets.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    by_label = known.groupBy("band", "key", "label").agg(F.count("*").alias("size"))
    several = by_label.groupBy("band", "key").agg(
        F.max(F.struct("size", "label"))["label"].alias("main"), F.sum("size").alias("n"), F.max("size").alias("most"), F.count("*").alias("classes")
    )
    several = several.filter("classes > 1")
    n_blocks = [F.ceil((F.col("n") - F.col("most")) / options.strays), F.ceil(F.col("n") / options.members)]
    blocks = several.select("band", "key", "main", *(x.cast("int").alias(c) for x, c in zip(n_blocks, "sm")))
    rows = known.select("band", "key", "id", "label").join(blocks, ["band", "key"]).withColumn("stray", F.col("label") != F.col("main"))
    own_s = F.pmod(F.xxhash64("id", "band"), F.col("s")).cast("int")
    own_m = F.pmod(F.xxhash64("id", "key"), F.col("m")).cast("int")
    all_s, all_m = (F.explode(F.sequence(F.lit(0), F.col(c) - 1)) for c in "sm")
    names = ["band", "key", "id", "label", "stray"]
    as_member = rows.select(*names, F.lit(False).alias("asks"), all_s.alias("sb"), own_m.alias("mb"))
    as_stray = rows.filter("stray").select(*names, F.lit(True).alias("asks"), own_s.alias("sb"), all_m.alias("mb"))
    sketched = shared.arrow_map(_needed(sets, rows.select("id"), options), _sketches(options), "id long, sketch binary").dropDuplicates(["id"])
    short = reps.select(F.col("doc_id").alias("id"), F.transform("bands", lambda x: F.shiftright(x, 32).cast("int")).alias("bands")).dropDuplicates(["id"])
    signed = tables.written(sketched.join(short, "id"), "near_sketches")
    signed = as_member.union(as_stray).join(signed, "id")
    dealt = signed.select(*PLACE, "asks", "stray", "id", "label", "sketch", "bands").repartition(*PLACE).sortWithinPartitions(*PLACE)
    least, low_bits, width = least_agreement(options), U(0x5555555555555555), options.sketch // 32

    def block(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        asks, stray, ids, label = (rows.column(c).to_numpy() for c in ("asks", "stray", "id", "label"))
        sketch = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), U).reshape(len(ids), width)
        keys = rows.column("bands").combine_chunks().flatten().to_numpy().reshape(len(ids), options.bands)
        place = [rows.column(c)[0].as_py() for c in PLACE]
        a, b = np.flatnonzero(asks), np.flatnonzero(~asks)
        most, askers, lists = np.full(len(b), -1), [], []
        step = max(1, (1 << 21) // (max(len(b), 1) * options.bands))
        for first in range(0, len(a), step):
            part = a[first : first + step]
            other = sketch[part][:, None] ^ sketch[b][None]
            alike = options.sketch - np.bitwise_count((other | (other >> U(1))) & low_bits).sum(axis=2, dtype=np.int64)
            ok = alike >= least
            ok &= (keys[part][:, None] == keys[b][None]).argmax(axis=2) == place[1]
            ok &= label[part][:, None] != label[b][None]
            ok &= ~stray[b][None] | (ids[part][:, None] < ids[b][None])
            most = np.maximum(most, np.where(ok, alike, -1).max(axis=0, initial=-1))
            for i in np.flatnonzero(ok.any(axis=1)).tolist():
                askers.append(part[i])
                lists.append(ids[b[ok[i]]])
        if askers:
            hit = np.flatnonzero(most >= 0)
            row = np.concatenate([np.array(askers), b[hit]])
            ends = np.concatenate([np.cumsum([0, *map(len, lists)]), np.full(len(hit), sum(map(len, lists)))]).astype(np.int32)
            rank = np.concatenate([np.full(len(askers), -1), options.sketch - most[hit]])
            columns = [pa.array(np.full(len(row), x, t)) for x, t in zip(place, (np.int64, *[np.int32] * 3))]
            columns += [pa.array(rank.astype(np.int32)), pa.array(ids[row]), pa.array(label[row])]
            columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(lists))))
            yield pa.RecordBatch.from_arrays(columns, [*PLACE, "rank", "id", "label", "others"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_place(batches):
            yield from block(rows)

    return shared.arrow_map(dealt, run, LISTED)


class _Askers:
    """The askers of one block: their complete sets in one sorted array, what each lists, and the classes linked so far."""

    def __init__(self, rows: list[tuple]) -> None:
        self.ids, self.labels, lists, sets = zip(*rows)
        self.size = np.array([len(x) for x in sets])
        flat = np.concatenate(sets)
        order = np.argsort(flat, kind="stable")
        self.elements, self.owner = flat[order], np.repeat(np.arange(len(sets)), self.size)[order]
        ids, asker = np.concatenate(lists), np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        order = np.argsort(ids, kind="stable")
        self.listed, self.asker = ids[order], asker[order]
        self.parent: dict[int, int] = {}

    def _root(self, label: int) -> int:
        while (up := self.parent.get(label, label)) != label:
            self.parent[label] = label = self.parent.get(up, up)
        return label

    def links(self, member: int, label: int, elements: np.ndarray, similarity: float) -> Iterator[tuple[int, int]]:
        """Those of the askers that list the member, are similar to it and are not of its class yet."""
        a, b = np.searchsorted(self.listed, [member, member + 1])
        asking = [i for i in self.asker[a:b].tolist() if self._root(self.labels[i]) != self._root(label)]
        if not asking:
            return
        first, end = (np.searchsorted(self.elements, elements, side) for side in ("left", "right"))
        n = end - first
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - first, n)
        common = np.bincount(self.owner[at], minlength=len(self.ids))
        for i in asking:
            mine, other = self._root(self.labels[i]), self._root(label)
            if mine != other and common[i] >= similarity * (self.size[i] + len(elements) - common[i]) - 1e-9:
                self.parent[max(mine, other)] = min(mine, other)
                yield self.ids[i], member


def _stray_links(lists: DataFrame, sets: DataFrame, options: NearOptions) -> DataFrame:
    """(a, b): listed pairs of the similarity or more, by complete sets; in a block, no more than join its classes.

    A block holds its askers' sets and meets one member's set after another.
    """
    joined = lists.join(_needed(sets, lists.select("id"), options), "id").repartition(*PLACE).sortWithinPartitions(*PLACE, "rank", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, waiting, askers = None, [], None
        for batch in batches:
            places = zip(*(batch.column(c).to_pylist() for c in PLACE))
            ranks, ids, labels = (batch.column(c).to_pylist() for c in ("rank", "id", "label"))
            sets_, others = batch.column("elements"), batch.column("others")
            found = []
            for i, here in enumerate(places):
                if here != place:
                    place, waiting, askers = here, [], None
                elements = sets_[i].values.to_numpy()
                if ranks[i] < 0:
                    waiting.append((ids[i], labels[i], others[i].values.to_numpy(), elements))
                    continue
                askers = askers or _Askers(waiting)
                found += askers.links(ids[i], labels[i], elements, options.similarity)
            yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in found], pa.int64()) for j in (0, 1)], ["a", "b"])

    return shared.arrow_map(joined, run, "a long, b long")


def _relabelled(tables: shared.Scratch, labels: DataFrame, links: DataFrame) -> DataFrame:
    """The labels after the links have been added."""
    tables.tables.append(connected(links.union(labels.select(F.col("id").alias("a"), F.col("label").alias("b"))), "near_labels"))
    return tables.tables[-1]


def near_classes(docs: DataFrame, options: NearOptions = NearOptions()) -> DataFrame:
    """doc_id, class_id (the least doc_id of the class), class_size and kept (doc_id is class_id), for each row of docs.

    Texts are linked at a Jaccard similarity of at least options.similarity over their shingles of words
    (runs between ASCII white space); links make classes. Texts without a word are each a class of their
    own, as are rows with a null doc_id, whose class_id is null. Rows that share a doc_id are of one class,
    and all kept or none. Only doc_id and text are used.
    """
    spark = docs.sparkSession
    shared.small_batches(spark)
    tables = shared.Scratch(spark)
    source = docs.select("doc_id", "text").filter("doc_id is not null")
    features = tables.written(shared.arrow_map(source, _features(options), FEATURES).filter("n_shingles > 0"), "near_features")
    same = features.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("rep"))
    written = tables.written(features.select("doc_id", "set_a", "set_b").join(same, ["set_a", "set_b"]).select("doc_id", "rep"), "near_members")
    members = written.distinct()
    reps = features.join(members.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi").select("doc_id", "bands")
    reps = tables.written(reps, "near_reps")
    tables.cleared(written, reps)
    slots = reps.select(F.col("doc_id").alias("id"), F.posexplode("bands").alias("band", "key"))
    # A key is a hash of its band too.
    crowded = slots.groupBy("key").agg(F.min("id").alias("least"), F.max("id").alias("most")).filter("least < most").select("key")
    buckets = tables.written(slots.join(crowded, "key").select("band", "key", "id").distinct(), "near_buckets")
    # While few documents meet, their ids go to the texts; else Spark brings both together.
    meet = shared.bounded(tables.written(buckets.select("id").distinct(), "near_ids"), options.most_broadcast)
    texts = shared.arrow_map(source.join(meet, F.col("doc_id") == F.col("id"), "left_semi"), _shingle_sets(options), "id long, elements array<long>")
    sets = tables.written(texts, "near_sets")
    sizes = sets.select("id", F.size("elements").alias("n")).groupBy("id").agg(F.min("n").alias("least"), F.max("n").alias("most"))
    sizes = tables.written(sizes, "near_sizes")

    # Rows that share a doc_id may have different texts: that links their classes.
    one = members.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("most")).filter("a < most")
    split = members.join(one, "doc_id").filter("rep > a").select("a", F.col("rep").alias("b"))
    # The buckets of a class mostly have the same first member by a hash of the id alone, so this makes few pairs.
    labels = connected(_linked(tables, _led(buckets, F.xxhash64("id")), sets, sizes, options).union(split), "near_labels")
    tables.tables.append(labels)
    # What that left apart meets another first member in each band.
    pairs = _led(buckets, F.xxhash64("id", "band"), labels)
    labels = _relabelled(tables, labels, _linked(tables, pairs, sets, sizes, options))
    # What is outside of its bucket's largest class even so meets all others of the bucket.
    lists = tables.written(_stray_lists(tables, buckets, labels, reps, sets, options), "near_lists")
    labels = _relabelled(tables, labels, _stray_links(lists, sets, options))
    tables.cleared(written, labels)
    classes = members.join(labels, F.col("rep") == F.col("id"), "left").select("doc_id", F.coalesce("label", "rep").alias("class_id"))
    # Rows that share a doc_id are of one class by now.
    joined = docs.select("doc_id").join(classes.dropDuplicates(["doc_id"]), "doc_id", "left").withColumn("class_id", F.coalesce("class_id", "doc_id"))
    # As a table of its own, so that Spark can split the rows of a large class.
    counts = joined.filter("class_id is not null").groupBy(F.col("class_id").alias("_class")).agg(F.count("*").alias("class_size"))
    sized = joined.join(tables.written(counts, "near_counts"), F.col("class_id") == F.col("_class"), "left")
    kept = F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True))
    return sized.select("doc_id", "class_id", F.coalesce("class_size", F.lit(1)).alias("class_size"), kept.alias("kept"))


def near_deduplicated(docs: DataFrame, options: NearOptions = NearOptions()) -> DataFrame:
    """One document of each class, with the columns of docs.

    The one with the least id stays, with all its rows if the id is repeated. Texts without a word and rows
    without an id stay.
    """
    drop = near_classes(docs, options).filter("not kept").select(F.col("doc_id").alias("_drop")).distinct()
    return docs.join(drop, docs["doc_id"] == drop["_drop"], "left_anti")
