"""Near-duplicate classes of documents by BagMinHash.

A document is the multiset of its five-word shingles (its words, if fewer). Two documents are
linked if the weighted Jaccard similarity of their multisets is at least 0.8; a class is a
connected component of links. The steps:

1. One pass over the texts gives each document the fingerprint of its multiset, the keys of 48
   bands of 7 BagMinHash components and a profile, the multiset's weight by buckets of the
   hashes. A pair at 0.8 shares a band with a chance of 1 - 1e-5. Equal multisets become one node.
2. Keys that several nodes share are buckets. In each, all nodes are compared with one hub, the
   node in the middle of a bounded sample of the bucket: no more pairs than rows.
3. Links are verified on the whole multisets, and connected components are found.
4. In buckets that still hold several components, the nodes outside the hub's component are
   compared with the rest, by profile and in packets. Two profiles bound the similarity from
   above, so a pair that they put below 0.8 is none, for certain; the others are verified as
   before, each pair once.

So links are found without listing the pairs of a group, and classes are those of all links.
Buckets are dealt over salted keys by their size, so no join sends one to a single task.

A null text is an empty one. Documents without words are equal if their texts are. Rows with a
null id are classified too, and a class of such rows alone has a null id. Rows that repeat an
id are rows each. An empty table gives an empty result. Only id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import bagminhash as B
from tessera.llm import words as W
from tessera.llm.common import discard, stored, tiles, utf8_buffers
from tessera.llm.components import components

SHINGLE, SIMILARITY, ROWS, BANDS = 5, 0.8, 7, 48
HUB_SAMPLE, PACKET, MEMBERS_PER_SALT = 64, 256, 512
#: Parts of every key before sizes are known.
SPREAD = 8
#: Rows that Python gets at once where a row holds two packets, two multisets, or a text.
PACKET_ROWS, BAG_ROWS, TEXT_ROWS = 16, 512, 2000
#: Bits of the filter that keeps unneeded texts from the shuffle: 8 for each document wanted, within these.
_FILTER_BITS = (1 << 16, 1 << 28)


def bags_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, shingle) with counts; a text of fewer than five words is one shingle."""
    words, at = W.text_words(data, offsets)
    starts, owner = W.gram_owner(at, SHINGLE)
    hashes = W.grams(words, SHINGLE)[starts]
    sizes = np.diff(at)
    short = np.flatnonzero((sizes > 0) & (sizes < SHINGLE))
    if len(short):
        value = np.zeros(len(short), np.uint64)
        for j in range(SHINGLE - 1):
            inside = sizes[short] > j
            value[inside] = W.mix(value[inside] + words[at[:-1][short[inside]] + j] * np.uint64(2 * j + 3))
        hashes, owner = np.concatenate([hashes, value]), np.concatenate([owner, short])
    return B.bags(hashes, owner)


def _prints(grams, owner, counts, data, offsets) -> np.ndarray:
    prints = B.fingerprints(grams, owner, counts, len(offsets) - 1)
    filled = np.bincount(owner, minlength=len(offsets) - 1) > 0
    for i in np.flatnonzero(~filled):
        digest = hashlib.blake2b(data[offsets[i] : offsets[i + 1]].tobytes(), digest_size=16).digest()
        prints[:, i] = np.frombuffer(digest, np.uint64)
    return prints.view(np.int64)


def _digests(text: str) -> dict:
    """Two hashes that, with the id, tell rows from each other."""
    return {f"d{i}": F.xxhash64(F.lit(i), F.col(text)) for i in (1, 2)}


def _signed(docs: DataFrame, key: str, text: str, digests: bool = False) -> DataFrame:
    hashes = _digests(text) if digests else {}
    more = list(hashes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8_buffers(batch.column(1))
            for a, b in tiles(offsets):
                part, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                grams, owner, counts = bags_of(part, at)
                prints = _prints(grams, owner, counts, part, at)
                signature = B.signatures(grams, owner, counts, b - a)
                weight = np.bincount(owner, weights=counts, minlength=b - a).astype(np.int64)
                bands, profile = B.band_keys(signature, ROWS, BANDS), B.profiles(grams, owner, counts, b - a)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(a, b - a), pa.array(prints[0]), pa.array(prints[1]), pa.array(weight),
                    pa.array([x.tobytes() if w else None for x, w in zip(bands, weight, strict=True)], pa.binary()),
                    pa.array(profile, pa.binary()),
                    *[batch.column(2 + i).slice(a, b - a) for i in range(len(more))],
                ], names=["id", "f1", "f2", "weight", "bands", "profile", *more])

    columns = [F.col(key).cast("long").alias("id"), F.col(text).alias("text"), *[c.alias(name) for name, c in hashes.items()]]
    return docs.select(*columns).mapInArrow(run, ", ".join(["id long, f1 long, f2 long, weight long, bands binary, profile binary", *[f"{name} long" for name in more]]))


def _band_rows(nodes: DataFrame) -> DataFrame:
    """A row (key, node) for each band of each node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = batch.column(0).to_numpy(zero_copy_only=False)
            keys = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.repeat(node, BANDS))], names=["key", "node"])

    return nodes.where("bands is not null").select("node", "bands").mapInArrow(run, "key long, node long")


def _salted(members: DataFrame) -> DataFrame:
    """Members with a part of their bucket, of which there are as many as its size needs."""
    return members.withColumn("salt", F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / MEMBERS_PER_SALT)))


def _for_each_salt(keys: DataFrame) -> DataFrame:
    """Rows of a bucket (key, size) once for each part of it."""
    return keys.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("size") / MEMBERS_PER_SALT) - 1))).drop("size")


def _hubs(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """key, hub, size: of a bounded sample of each bucket the node most like the others of it."""
    order = Window.partitionBy("key").orderBy(F.xxhash64("node"), "node")
    sample = members.where("size > 2").withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= HUB_SAMPLE)
    profiled = sample.join(nodes.select("node", "profile"), "node")
    lists = profiled.groupBy("key", "size").agg(F.collect_list(F.struct("node", "profile")).alias("m"))  # HUB_SAMPLE at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hubs = []
            for rows in batch.column(2).to_pylist():
                rows.sort(key=lambda m: m["node"])
                x = B.Profiles([m["profile"] for m in rows]).coarse.astype(np.int64)
                shared = np.array([np.minimum(one, x).sum(1) / np.maximum(one, x).sum(1) for one in x])
                hubs.append(rows[int(shared.sum(1).argmax())]["node"])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hubs, pa.int64()), batch.column(1)], names=["key", "hub", "size"])

    large = lists.mapInArrow(run, "key long, hub long, size long")
    return large.unionByName(members.where("size = 2").groupBy("key").agg(F.min("node").alias("hub"), F.lit(2).cast("long").alias("size")))


def _wanted_filter(ids: DataFrame, bits: int) -> np.ndarray:
    """A bit for each hashed id, built by aggregation on the executors."""
    slot = F.pmod(F.xxhash64("id"), F.lit(bits))
    words = ids.select((slot / 64).cast("long").alias("word"), F.expr("shiftleft(1L, cast(pmod(xxhash64(id), 64) as int))").alias("bit"))
    out = np.zeros(bits // 64, np.int64)
    for r in words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toLocalIterator():  # bits / 64 rows at most
        out[r["word"]] = r["bits"]
    return out.view(np.uint64)


def _bags(docs: DataFrame, nodes: DataFrame, key: str, text: str) -> DataFrame:
    """node, grams and counts of the nodes in buckets: their texts are read again."""
    spark = docs.sparkSession
    bits = 1 << int(np.clip(8 * nodes.count(), *_FILTER_BITS)).bit_length() - 1
    wanted = spark.sparkContext.broadcast(_wanted_filter(nodes.select("id"), bits))
    hashed = docs.select(F.xxhash64(F.col(key).cast("long")).alias("h"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = wanted.value
        for batch in batches:
            h = batch.column(0).to_numpy(zero_copy_only=False)
            word = np.mod(h, bits) // 64
            kept = np.flatnonzero(table[word] >> np.mod(h, 64).astype(np.uint64) & np.uint64(1))
            texts = batch.column(1).take(pa.array(kept))
            data, offsets = utf8_buffers(texts)
            for a, b in tiles(offsets):
                part, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                grams, owner, counts = bags_of(part, at)
                prints = _prints(grams, owner, counts, part, at)
                cuts = np.searchsorted(owner, np.arange(b - a + 1))
                yield pa.RecordBatch.from_arrays([
                    pa.array(prints[0]), pa.array(prints[1]),
                    pa.array([grams[i:j].tobytes() for i, j in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()),
                    pa.array([counts[i:j].astype(np.uint32).tobytes() for i, j in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()),
                ], names=["f1", "f2", "grams", "counts"])

    read = hashed.mapInArrow(run, "f1 long, f2 long, grams binary, counts binary")
    # several rows of one multiset may have passed the filter
    return read.join(nodes.select("node", "f1", "f2"), ["f1", "f2"]).groupBy("node").agg(F.first("grams").alias("grams"), F.first("counts").alias("counts"))


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Of two multisets as (sorted distinct elements, counts)."""
    at = np.searchsorted(b[0], a[0])
    at[at == len(b[0])] = 0
    same = b[0][at] == a[0] if len(b[0]) else np.zeros(len(a[0]), bool)
    least = int(np.minimum(a[1][same], b[1][at[same]]).sum())
    most = int(a[1].sum()) + int(b[1].sum()) - least
    return least / most if most else 1.0


def _verified(pairs: DataFrame, bags: DataFrame, threshold: float) -> DataFrame:
    """The pairs (u, v) whose multisets are similar enough."""
    left = bags.select(F.col("node").alias("u"), F.col("grams").alias("gu"), F.col("counts").alias("cu"))
    right = bags.select(F.col("node").alias("v"), F.col("grams").alias("gv"), F.col("counts").alias("cv"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for i in range(batch.num_rows):
                bag = [(np.frombuffer(batch.column(c)[i].as_buffer(), np.uint64), np.frombuffer(batch.column(c + 1)[i].as_buffer(), np.uint32).astype(np.int64)) for c in (2, 4)]
                # least / most >= threshold, with whole numbers on both sides where 0.8 is 4/5
                kept.append(weighted_jaccard(*bag) >= threshold - 1e-12)
            mask = pa.array(kept, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["u", "v"])

    joined = pairs.join(left, "u").join(right, "v").select("u", "v", "gu", "cu", "gv", "cv")
    return joined.mapInArrow(run, "u long, v long")


_PACKET_TYPE = pa.list_(pa.struct([("node", pa.int64()), ("label", pa.int64()), ("weight", pa.int64()), ("profile", pa.binary()), ("bands", pa.binary())]))
_MEMBER = "struct<node:long,label:long,weight:long,profile:binary,bands:binary>"


def _packets(members: DataFrame, name: str) -> DataFrame:
    """key, hub_label, size and lists of at most PACKET members of a part of a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []

        def packets(found: list[tuple]) -> pa.RecordBatch:
            keys = zip(*[k for k, _ in found], strict=True)
            return pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in keys], pa.array([r for _, r in found], _PACKET_TYPE)], names=["key", "hub_label", "size", name])

        for batch in batches:
            out: list[tuple] = []
            for *k, member in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if rows and (k != key or len(rows) >= PACKET):
                    out.append((key, rows))
                    rows = []
                key = k
                rows.append(member)
            if out:
                yield packets(out)
        if rows:
            yield packets([(key, rows)])

    dealt = members.repartition("key", "salt").sortWithinPartitions("key", "salt")
    return dealt.select("key", "hub_label", "size", F.struct("node", "label", "weight", "profile", "bands").alias("m")).mapInArrow(run, f"key long, hub_label long, size long, {name} array<{_MEMBER}>")


def _rest_pairs(members: DataFrame, threshold: float) -> DataFrame:
    """Pairs of different components within a bucket that the profiles do not rule out, each pair
    in the first band that both share only. `members` are those of mixed buckets, with hub_label."""
    outer = _packets(members.where("label <> hub_label"), "outer")
    every = _packets(members, "every")

    def columns(rows):
        number = lambda f: np.array([m[f] for m in rows], np.int64)
        return number("node"), number("label"), number("weight"), np.array([np.frombuffer(m["bands"], np.int64) for m in rows]), B.Profiles([m["profile"] for m in rows])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for i in range(batch.num_rows):
                key, hub_label = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                node, label, weight, bands, profile = columns(batch.column(3)[i].as_py())
                *asking, own = columns(batch.column(2)[i].as_py())
                for k, m in enumerate(zip(*asking, strict=True)):
                    # of two outer nodes the smaller one asks
                    open_ = (label != m[1]) & ((label == hub_label) | (node > m[0]))
                    open_ &= (weight >= threshold * m[2] - 1e-9) & (m[2] >= threshold * weight - 1e-9)
                    at = np.flatnonzero(open_)
                    enough = threshold / (1 + threshold) * (weight[at] + m[2]) - 1e-6
                    at = at[own.most_shared(k, profile, at, enough) >= enough]
                    if len(at):
                        shared = bands[at] == m[3]
                        first = bands[at][np.arange(len(at)), shared.argmax(1)]
                        found += [(min(m[0], x), max(m[0], x)) for x in node[at[first == key]].tolist()]
            u, v = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    # each outer packet goes to one part of its bucket, and all packets of the bucket to every part
    asked = outer.withColumn("salt", F.pmod(F.xxhash64(F.col("outer")[0]["node"]), F.ceil(F.col("size") / MEMBERS_PER_SALT))).drop("size")
    met = asked.join(_for_each_salt(every).drop("hub_label"), ["key", "salt"]).select("key", "hub_label", "outer", "every")
    return met.mapInArrow(run, "u long, v long")


def classes(docs: DataFrame, *, key: str = "doc_id", text: str = "text", threshold: float = SIMILARITY) -> DataFrame:
    """id, class_id (the least id of its class) and text_class (of those with its multiset) of
    every document."""
    return _classed(docs, key, text, threshold)


def _classed(docs: DataFrame, key: str, text: str, threshold: float = SIMILARITY, digests: bool = False) -> DataFrame:
    """The rows of classes(); with `digests` instead d1, d2, class (a node) and id."""
    extra = ["d1", "d2"] if digests else []
    tables: list[str] = []
    kept = partial(stored, into=tables)
    rows = kept(_signed(docs, key, text, digests).withColumn("row", F.monotonically_increasing_id()), "neardup-signed", TEXT_ROWS)
    nodes = rows.groupBy("f1", "f2").agg(F.min("id").alias("id"), F.min("row").alias("node"), *[F.first(c).alias(c) for c in ("weight", "bands", "profile")])
    nodes = kept(nodes, "neardup-nodes")
    band_rows = _band_rows(nodes)
    shared = band_rows.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    part = F.pmod(F.xxhash64("node"), F.lit(SPREAD))
    spread = shared.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SPREAD - 1).cast("long"))))
    members = kept(_salted(band_rows.withColumn("part", part).join(spread, ["key", "part"]).drop("part")), "neardup-buckets")
    in_buckets = kept(nodes.join(members.select("node").distinct(), "node", "left_semi"), "neardup-candidates")
    hubs = kept(_hubs(members, in_buckets), "neardup-hubs")
    bags = kept(_bags(docs, in_buckets, key, text), "neardup-bags", TEXT_ROWS)

    pairs = members.join(_for_each_salt(hubs), ["key", "salt"]).where("node <> hub").select(F.least("node", "hub").alias("u"), F.greatest("node", "hub").alias("v")).distinct()
    links = kept(_verified(pairs, bags, threshold), "neardup-links", BAG_ROWS)
    label = kept(components(links, tables), "neardup-labels")

    named = in_buckets.select("node", "weight", "profile", "bands").join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    with_hub = hubs.join(named.select(F.col("node").alias("hub"), F.col("label").alias("hub_label")), "hub").select("key", "hub_label", "size")
    # only buckets that hold several components go on
    light = members.join(named.select("node", "label"), "node").join(_for_each_salt(with_hub), ["key", "salt"])
    mixed = light.where("label <> hub_label").select("key", "size").distinct()
    left = kept(light.join(_for_each_salt(mixed), ["key", "salt"], "left_semi"), "neardup-mixed")
    rest = kept(_rest_pairs(left.join(named.drop("label"), "node"), threshold), "neardup-rest", PACKET_ROWS)
    if rest.head(1):  # else the components are the classes already
        more = kept(_verified(rest, bags, threshold), "neardup-more", BAG_ROWS)
        edges = label.select(F.col("node").alias("u"), F.col("label").alias("v")).unionByName(more)
        label = components(edges, tables)
    label = label.withColumnRenamed("label", "class")

    classed = nodes.select("node", "id", "f1", "f2").join(label, "node", "left").withColumn("class", F.coalesce("class", "node"))
    least = classed.groupBy("class").agg(F.min("id").alias("class_id"))
    named_nodes = classed.join(least, "class").select("f1", "f2", F.col("id").alias("text_class"), "class_id", *(["class"] if digests else []))
    out = rows.select("id", "f1", "f2", *extra).join(named_nodes, ["f1", "f2"])
    out = out.select(*extra, "class", "id") if digests else out.select(F.col("id").alias(key), "class_id", "text_class")
    out = stored(out, "neardup-classes")
    discard(docs.sparkSession, tables)
    return out


def deduplicate(docs: DataFrame, *, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents with their columns, of each class one row: of the least id and, where texts
    of one class share it, the least digest. Rows without an id are a group of their own within
    a class and one of them stays; of rows that repeat id and text one stays."""
    found = _classed(docs, key, text, digests=True, **options)
    rows = found.select("class", F.col("id").isNull().alias("unnamed"), F.struct("id", "d1", "d2").alias("row"))
    least = rows.groupBy("class", "unnamed").agg(F.min("row").alias("least"), F.count("*").alias("n")).where("n > 1")
    met = rows.join(least, ["class", "unnamed"])
    dropped = met.where(F.col("row") != F.col("least")).select("row.*").distinct()
    names = {"id": "__id", "d1": "__d1", "d2": "__d2"}
    own = {"__id": F.col(key).cast("long"), **{f"__{name}": c for name, c in _digests(text).items()}}
    same = F.lit(True)
    gone = dropped.withColumnsRenamed({name: f"gone_{name}" for name in names})
    for name, mine in names.items():
        same = same & F.col(mine).eqNullSafe(F.col(f"gone_{name}"))
    kept = docs.withColumns(own).join(gone, same, "left_anti")
    if met.where(F.col("row") == F.col("least")).groupBy("row").count().where("count > 1").head(1):
        kept = kept.dropDuplicates(list(names.values()))
    return kept.select(docs.columns)
