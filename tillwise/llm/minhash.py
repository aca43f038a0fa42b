"""Near duplicates by a multi-index Hamming join of b-bit MinHash signatures, confirmed on full shingle sets."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillwise.llm.common import Words, forget, grams, mix, slices, text_or_empty, written
from tillwise.llm.components import components

_RNG = np.random.default_rng(9)


@dataclass(frozen=True)
class Scheme:
    """Signatures of chunks x width indexed symbols of `bits` bits and `further` symbols of 8 bits.

    Two signatures that differ in at most `distance` indexed symbols agree, in some chunk, in all but one
    symbol (pigeonhole); so each chunk is looked up once for each symbol left out, and every pair within the
    distance is found for certain. Of these pairs those go on to their full sets that differ in at most
    `limit` of all symbols.

    A symbol of two sets of similarity s differs with probability 1 - s. At s = 0.85 more than 15 of 32
    differ with probability 3e-6, at 0.8 with 2e-4; more than `limit` of all with about 1e-6."""

    chunks: int = 8
    width: int = 4
    bits: int = 20
    further: int = 480

    @property
    def symbols(self) -> int:
        return self.chunks * self.width

    @property
    def distance(self) -> int:
        return 2 * self.chunks - 1

    def limit(self, percent: int) -> int:
        """Symbols in which sets of this similarity may differ: the mean and five standard deviations."""
        n, s = self.symbols + self.further, percent / 100
        return int(n * (1 - s) + 5 * (n * s * (1 - s)) ** 0.5)

    def sign(self, shingles: np.ndarray, first: np.ndarray) -> list[bytes]:
        """Signatures of the sets that begin at `first` in `shingles`: indexed symbols, then the others."""
        indexed = np.empty((len(first), self.symbols), dtype=np.uint32)
        others = np.empty((len(first), self.further), dtype=np.uint8)
        for i in range(self.symbols + self.further):
            low = mix(np.minimum.reduceat(shingles * _FACTOR[i] + _SHIFT[i], first))
            if i < self.symbols:
                indexed[:, i] = (low >> np.uint64(64 - self.bits)).astype(np.uint32)
            else:
                others[:, i - self.symbols] = (low >> np.uint64(56)).astype(np.uint8)
        return [a.tobytes() + b.tobytes() for a, b in zip(indexed, others)]

    def parts(self, signatures: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The indexed and the other symbols of signatures, a row for each."""
        whole = np.frombuffer(b"".join(signatures), dtype=np.uint8).reshape(len(signatures), -1)
        return np.ascontiguousarray(whole[:, :4 * self.symbols]).view(np.uint32), whole[:, 4 * self.symbols:]

    def keys(self, signature: np.ndarray) -> np.ndarray:
        """n x (chunks * width) look-up keys: a chunk, the symbol left out, and the other symbols."""
        parts = signature.reshape(len(signature), self.chunks, self.width).astype(np.uint64)
        out = np.empty((len(signature), self.chunks, self.width), dtype=np.uint64)
        for skip in range(self.width):
            code = np.arange(self.chunks, dtype=np.uint64)[None, :] * np.uint64(self.width) + np.uint64(skip)
            code = np.broadcast_to(code, parts.shape[:2])
            for j in range(self.width):
                if j != skip:
                    code = mix(code * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, j])
            out[:, :, skip] = code
        return out.reshape(len(signature), -1).view(np.int64)


_FACTOR = _RNG.integers(0, 2**63, 1024, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFT = _RNG.integers(0, 2**63, 1024, dtype=np.uint64)
#: members of a bucket in a block
BLOCK = 512
#: members, and bytes of their sets, in a block of a family
FAMILY, FAMILY_BYTES = 512, 8 << 20
#: a shingle in at most so many sets of a task is counted pair by pair; columns of one matrix product
FEW, COLUMNS = 32, 4096


def shingle_sets(texts: pa.Array, words_each: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, texts one after another and sorted within, and the bounds of
    each text. A text with fewer words has its whole sequence as one shingle, one without words none."""
    words = Words(texts)
    hashes = words.hashes(lower=True)
    size = max(0, len(hashes) - words_each + 1)
    start = np.flatnonzero(words.row[:size] == words.row[words_each - 1:words_each - 1 + size]) if size else np.zeros(0, dtype=np.int64)
    code, row = grams(hashes, words_each)[start], words.row[start]
    for n in range(1, words_each):
        short = np.flatnonzero(words.count == n)
        if len(short):
            at = words.first[short]
            whole = grams(hashes, n)[at] ^ np.uint64(n)
            code, row = np.concatenate([code, whole]), np.concatenate([row, short])
    order = np.lexsort((code, row))
    code, row = code[order], row[order]
    new = np.ones(len(code), dtype=bool)
    new[1:] = (code[1:] != code[:-1]) | (row[1:] != row[:-1])
    code, row = code[new], row[new]
    return code, np.searchsorted(row, np.arange(len(texts) + 1))


def signed(df: DataFrame, id_col: str, text_col: str, words_each: int, scheme: Scheme) -> DataFrame:
    """(id, n_shingles, s1, s2, signature): size, a 128-bit code and the signature of each shingle set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                code, bounds = shingle_sets(part.column("_text"), words_each)
                size = np.diff(bounds)
                some = np.flatnonzero(size)
                codes = np.zeros((2, len(size)), dtype=np.uint64)
                signature = [None] * len(size)
                if len(some):
                    at = bounds[:-1][some]
                    for k in range(2):
                        codes[k][some] = np.add.reduceat(mix(code ^ np.uint64(0xA5A5A5A5 * k + 1)), at)
                    for i, s in zip(some.tolist(), scheme.sign(code, at)):
                        signature[i] = s
                yield pa.RecordBatch.from_arrays([
                    part.column("id"), pa.array(size, pa.int64()), pa.array(codes[0].view(np.int64)), pa.array(codes[1].view(np.int64)),
                    pa.array(signature, pa.binary())], ["id", "n_shingles", "s1", "s2", "signature"])

    rows = df.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("_text"))
    return rows.mapInArrow(run, "id long, n_shingles long, s1 long, s2 long, signature binary")


def _bucket_rows(classes: DataFrame, scheme: Scheme) -> DataFrame:
    """(key, id): one row for each class and look-up key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = scheme.keys(scheme.parts(batch.column("signature").to_pylist())[0])
                ids = np.repeat(np.asarray(batch.column("id")), keys.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(ids)], ["key", "id"])

    return classes.select("id", "signature").mapInArrow(run, "key long, id long")


def _near(pairs: DataFrame, classes: DataFrame, scheme: Scheme, percent: int) -> DataFrame:
    """The pairs (a, b) whose signatures are within the scheme's distance and limit."""
    limit = scheme.limit(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                (x, u), (y, v) = (scheme.parts(batch.column(c).to_pylist()) for c in ("sa", "sb"))
                far = (x != y).sum(axis=1)
                ok = pa.array((far <= scheme.distance) & (far + (u != v).sum(axis=1) <= limit))
                yield pa.RecordBatch.from_arrays([batch.column("a").filter(ok), batch.column("b").filter(ok)], ["a", "b"])

    one, two = classes.select(F.col("id").alias("a"), F.col("signature").alias("sa")), classes.select(F.col("id").alias("b"), F.col("signature").alias("sb"))
    return pairs.join(one, "a").join(two, "b").mapInArrow(run, "a long, b long")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union of their full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("xa"), batch.column("xb")):
                x, y = (np.frombuffer(s.as_buffer(), dtype=np.uint64) for s in (x, y))
                both = np.sort(np.concatenate([x, y]))
                common = int((both[1:] == both[:-1]).sum())
                ok.append(100 * common >= percent * (len(x) + len(y) - common))
            ok = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(ok), batch.column("b").filter(ok)], ["a", "b"])

    one, two = sets.select(F.col("id").alias("a"), F.col("set").alias("xa")), sets.select(F.col("id").alias("b"), F.col("set").alias("xb"))
    # the sets travel once for each pair's second side and once for themselves; those of a hub are repeated
    # in the task that joins them, not in the shuffle
    return pairs.join(two, "b").join(one, "a").mapInArrow(run, "a long, b long")


def _full_sets(df: DataFrame, needed: DataFrame, id_col: str, text_col: str, words_each: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                code, bounds = shingle_sets(part.column("_text"), words_each)
                sets = [code[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(sets, pa.binary())], ["id", "set"])

    rows = df.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("_text"))
    return rows.join(needed, "id", "left_semi").mapInArrow(run, "id long, set binary").dropDuplicates(["id"])


def _labels(linked: np.ndarray) -> np.ndarray:
    """For each node of a graph given by its symmetric adjacency matrix the first node that it can reach."""
    label = np.full(len(linked), -1)
    for start in range(len(linked)):
        if label[start] >= 0:
            continue
        label[start] = start
        queue = [start]
        while queue:
            found = np.flatnonzero(linked[queue.pop()] & (label < 0))
            label[found] = start
            queue.extend(found.tolist())
    return label


def _in_blocks(rows: DataFrame, group: list[str], blocks: Column, columns: list[str], links: Callable[[pa.Table], np.ndarray]) -> DataFrame:
    """Edges (a, b) that join whom the links inside each group join; members are compared in pairs of blocks.

    A group of more than one block meets in one task for each pair of blocks, so no group lies in one task and
    none is cut short. `links` gets a pair's members and returns who is linked with whom; the task returns, for each
    member, the smallest member it can reach. A member of many groups is then tied to the least of those and they to
    one another, so there are about as many edges as members, whatever the number of links and groups."""
    rows = rows.withColumn("_blocks", blocks).withColumn("_mine", F.pmod(F.xxhash64("id"), F.col("_blocks")).cast("int"))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    rows = rows.select(*group, F.least("_mine", "_other").alias("i"), F.greatest("_mine", "_other").alias("j"), "_mine", *columns)

    def solve(table: pa.Table) -> pa.RecordBatch | None:
        ids, roots, mine = (np.asarray(table.column(c)) for c in ("id", "root", "_mine"))
        if len(ids) < 2 or (roots == roots[0]).all():
            return None
        linked = links(table) & (roots[:, None] != roots[None, :])
        if (mine != mine[0]).any():  # pairs inside one block meet where the block meets itself
            linked &= mine[:, None] != mine[None, :]
        order = np.argsort(ids, kind="stable")
        label = _labels(linked[np.ix_(order, order)])
        some = np.flatnonzero(label != np.arange(len(label)))
        return pa.RecordBatch.from_arrays([pa.array(ids[order[label[some]]]), pa.array(ids[order[some]])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        at = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([np.asarray(batch.column(c)).astype(np.int64) for c in (*group, "i", "j")])
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for low, high in zip(cuts[:-1], cuts[1:]):
                here = keys[:, low].tolist()
                if held and here != at:
                    found = solve(pa.Table.from_batches(held))
                    if found is not None:
                        yield found
                    held = []
                at = here
                held.append(batch.slice(low, high - low))
        if held:
            found = solve(pa.Table.from_batches(held))
            if found is not None:
                yield found

    # a set number of partitions: few bytes may be much work here, so they are not to be put together
    number = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(number, *group, "i", "j").sortWithinPartitions(*group, "i", "j")
    found = dealt.mapInArrow(run, "a long, b long").distinct()
    # as many rows of one b as it is in groups and pairs of blocks
    found = found.withColumn("least", F.min("a").over(Window.partitionBy("b")))
    return found.select(F.col("least").alias("a"), F.explode(F.array("a", "b")).alias("b")).where("a <> b").distinct()


def _candidates(rows: DataFrame, classes: DataFrame, scheme: Scheme, percent: int) -> DataFrame:
    """Edges (a, b) over the members (key, id, root, n) of buckets that join all pairs of one bucket and different
    components within the signature distance and limit."""
    limit = scheme.limit(percent)

    def near(table: pa.Table) -> np.ndarray:
        signature, others = scheme.parts(table.column("signature").to_pylist())
        out = np.zeros((len(signature), len(signature)), dtype=bool)
        for low in range(0, len(signature), 64):
            far = np.zeros((len(signature[low:low + 64]), len(signature)), dtype=np.int16)
            for k in range(signature.shape[1]):
                far += signature[low:low + 64, k][:, None] != signature[:, k][None, :]
            x, y = np.nonzero(far <= scheme.distance)
            for at in range(0, len(x), 1 << 14):
                u, v = x[at:at + (1 << 14)], y[at:at + (1 << 14)]
                close = far[u, v] + (others[low + u] != others[v]).sum(axis=1) <= limit
                out[low + u[close], v[close]] = True
        return out

    rows = rows.join(classes.select("id", "signature"), "id")
    return _in_blocks(rows, ["key"], F.ceil(F.col("n") / BLOCK).cast("int"), ["id", "root", "signature"], near)


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, exact. Shingles in few sets are counted pair by pair, those in many
    by a matrix product."""
    m = len(sets)
    code = np.concatenate(sets)
    row = np.repeat(np.arange(m), [len(s) for s in sets])
    order = np.argsort(code, kind="stable")
    code, row = code[order], row[order]
    first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
    times = np.diff(np.append(first, len(code)))
    column = np.repeat(np.arange(len(first)), times)
    out = np.zeros(m * m)
    few = times[column] <= FEW
    r, c = row[few], column[few]
    for low in range(0, len(r), 1 << 18):
        cells = []
        for step in range(1, FEW):
            same = low + np.flatnonzero(c[low + step:low + step + (1 << 18)] == c[low:low + (1 << 18)][:max(0, len(c) - step - low)])
            cells.append(r[same] * m + r[same + step])
        out += np.bincount(np.concatenate(cells), minlength=m * m)
    out = out.reshape(m, m)
    out += out.T
    number = np.cumsum(times > FEW) - 1
    r, c = row[~few], number[column[~few]]
    for low in range(0, int(c[-1]) + 1 if len(c) else 0, COLUMNS):
        a, b = np.searchsorted(c, (low, low + COLUMNS))
        here = np.zeros((m, COLUMNS), dtype=np.float32)
        here[r[a:b], c[a:b] - low] = 1
        out += here @ here.T
    return out


def _family_links(members: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) that join what confirmed links between different components of a family join: members
    (family, id, root, n, size, set), all pairs of a family being compared by full sets inside the tasks."""

    def linked(table: pa.Table) -> np.ndarray:
        sets = [np.frombuffer(s.as_buffer(), dtype=np.uint64) for s in table.column("set")]
        size = np.array([len(s) for s in sets], dtype=np.float64)
        common = intersections(sets)
        out = 100 * common >= percent * (size[:, None] + size[None, :] - common)
        np.fill_diagonal(out, False)
        return out

    blocks = F.greatest(F.ceil(F.col("n") / FAMILY), F.ceil(F.col("size") / FAMILY_BYTES)).cast("int")
    return _in_blocks(members, ["family"], blocks, ["id", "root", "set"], linked)


def _open_members(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """(key, id, n, root): the members of buckets that hold more than one component, that is, one that is not
    the hub's."""
    hub = roots.select(F.col("node").alias("a"), F.col("root").alias("_top"))
    own = roots.select(F.col("node").alias("id"), "root")
    pairs = shared.where("a <> id").select("a", "id").distinct().join(hub, "a", "left").join(own, "id", "left")
    pairs = pairs.where(F.coalesce("root", "id") != F.coalesce("_top", "a")).select("a", "id")
    keys = shared.join(pairs, ["a", "id"], "left_semi").select("key").distinct()
    members = shared.join(keys, "key", "left_semi").select("key", "id", "n")
    return written(members.join(own, "id", "left").withColumn("root", F.coalesce("root", "id")), "minhash-open")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_each: int = 5, percent: int = 80,
                    scheme: Scheme | None = None) -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row: rows are linked if 100 * intersection >= percent *
    union of their distinct `words_each`-word shingles (A-Z folded), and component_id is the smallest id that
    can be reached.

    1. Rows with one and the same set are one class; the smallest id stands for it, so copies cost nothing.
    2. In each bucket of the multi-index the smallest member is the hub. Pairs with the hub that lie within
       the signature distance and limit are confirmed on full sets and joined to components.
    3. Buckets whose members are all in one component are done: further links inside could change nothing. In
       the others members are compared across components by signature, in blocks; those that pairs within
       distance and limit join are families.
    4. All pairs of a family, again in blocks, are compared by full sets inside the tasks, which return
       whom the confirmed links join, not the links. So no step's rows grow with the square of a family.

    Null and empty texts have no shingles and link with nothing; null ids neither. Rows with the same id are
    one node. An empty table gives no rows; other columns are not read."""
    scheme = scheme or Scheme()
    rows = written(signed(df, id_col, text_col, words_each, scheme), "minhash-signed")
    live = rows.where("n_shingles > 0 and id is not null")
    classes = written(live.groupBy("s1", "s2", "n_shingles").agg(F.min("id").alias("id"), F.min_by("signature", "id").alias("signature")), "minhash-classes")
    buckets = written(_bucket_rows(classes, scheme), "minhash-buckets")
    # grouped by the key and a function of it: the join below then shuffles both sides anew, so that
    # adaptive execution can split a hot bucket
    hubs = buckets.groupBy("key", F.shiftright("key", 32).alias("_high")).agg(F.min("id").alias("a"), F.count("*").alias("n")).where("n > 1")
    shared = written(buckets.join(hubs.drop("_high"), "key"), "minhash-shared")
    first = written(_near(shared.where("a <> id").select("a", F.col("id").alias("b")).distinct(), classes, scheme, percent), "minhash-pairs")
    needed = first.select(F.col("a").alias("id")).union(first.select("b")).distinct()
    sets = written(_full_sets(df, needed, id_col, text_col, words_each), "minhash-sets")
    links = written(_confirmed(first, sets, percent), "minhash-links")
    roots = components(links)

    open_ = _open_members(shared, roots)
    families = components(written(_candidates(open_, classes, scheme, percent), "minhash-candidates"))
    own = roots.select(F.col("node").alias("_node"), F.col("root").alias("_root"))
    members = families.select(F.col("node").alias("id"), F.col("root").alias("family")).join(own, F.col("id") == F.col("_node"), "left")
    members = written(members.select("id", "family", F.coalesce("_root", "id").alias("root")), "minhash-families")
    more_sets = written(_full_sets(df, members.select("id"), id_col, text_col, words_each), "minhash-sets")
    sized = members.join(more_sets, "id")
    sized = sized.join(sized.groupBy("family").agg(F.count("*").alias("n"), F.sum(F.octet_length("set")).alias("size")), "family")
    more = written(_family_links(sized, percent), "minhash-links")
    if more.limit(1).count():
        roots = components(links.unionByName(more))
    forget(buckets, shared, first, sets, open_, members, more_sets)

    found = classes.select(F.col("s1").alias("_s1"), F.col("s2").alias("_s2"), F.col("n_shingles").alias("_n"), F.col("id").alias("_id"))
    found = written(found.join(roots, F.col("_id") == F.col("node"), "left").select("_s1", "_s2", "_n", F.coalesce("root", "_id").alias("component_id")), "minhash-roots")
    here = (F.col("s1") == F.col("_s1")) & (F.col("s2") == F.col("_s2")) & (F.col("n_shingles") == F.col("_n")) & (F.col("n_shingles") > 0) & F.col("id").isNotNull()
    out = rows.drop("signature").join(found, here, "left")
    return out.select(F.col("id").alias(id_col), "n_shingles", F.coalesce("component_id", "id").alias("component_id")).withColumn(
        "kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))
