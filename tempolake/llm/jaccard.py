"""N-gram Jaccard join with a token-group matrix.

1. Every text becomes its set of distinct word shingles (64-bit hashes). Equal sets
   make one class; only one document of a class goes on.
2. Candidate search: sets sign parts of the hash range. It loses no link, as shown below. A set that shares fewer
   signatures with others than a linked set would goes, round by round.
3. Groups: each set goes to the group of a lead, the least set of a signature, with which it shares most. Large
   groups are cut into tiles of bounded size, each with the lead. In a tile, the token-group matrix partitions
   its sets by their least shared token, keeps each part's union of tokens with their counts, bounds the overlap of a
   set with a part by the union, and only parts whose bound can reach t are opened and verified, set
   by set. Each set is sent once, so near copies are connected by work in proportion to their number.
4. Sets that are connected now need no comparison. A signature whose holders are all connected goes, and with
   it sets that share too few of the others. ``ROUNDS`` times, what is left meets leads of other components.
5. What then still shares signatures across components is compared as a whole, by families. Two sets are in one family
   if they share as many signatures as linked sets would, or a frequent one among the rarest of both; sharing a few
   signatures each with many sets makes no family. Families are cut into cells, the largest component of each apart from the
   others, and each two cells make a tile of bounded size, but for two cells of the largest component. So a family of near
   copies pays for the sets that aren't connected yet, times all, and not for all pairs.
6. Verified links give the components.

Why no link is lost. Let linked sets A and B have a <= b elements, c of them in common, and u in their union, so
c >= t u. As c <= a, u <= a / t, and they differ in u - c <= u (1 - t) <= a (1 - t) / t elements, D at most (``most_apart``).
The hash range is cut into parts; a part's signature stands for all elements in it and its place. A set signs its first
S = S(a) parts that hold elements. At most D parts differ between A and B. Suppose A has S such parts, of which x
differ in B, and y parts before the last of them hold elements of B only; x + y <= D. The other S - x are parts of B with the
same elements, and at most y of them are beyond B's first S: S - D signatures are shared at least, which is over 0 as S > D.
It is the same if only B has S parts. b signs at the level of a, too, as it signs at all levels from that of
ceil(b t) up, and a >= b t; and it signs S(b) >= S(a) parts there. If neither set has so many parts, both also sign their least elements one by one,
n - ceil(n t) + 1 of n: as c >= t b and c >= t a, A and B have ceil(t b) elements in common, and the least of these is among the first of
both. So linked sets share max(need(A), need(B)) signatures at least, need being 1 for sets that sign elements, and S - D at the least size
that a set can be linked with for others. Order all signatures by their number of holders: the first one that A and B share has need(A) - 1
others after it in A, so it is among the first n - need(A) + 1 of A's n signatures, and likewise of B's. Families
are made of these: the rarest signatures of each set show every link. Two sets with D = 0 are linked only if they are equal,
and make one class. All bounds are in integers, and hold for 0 < num <= den. (Two different elements, parts or sets may
have one 64-bit hash, by chance.)

Texts are shuffled once, and of the rest only hashes. The driver holds nothing that
grows with the table.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textkernel as K
from .components import components
from .shared import apart, drop_stored, stored

#: About so many shingles of a group make a tile; a cell of what is left at the end has up to so many.
TILE_TOKENS, CELL_TOKENS = 1 << 15, 500_000
#: How often sets meet leads before the rest is compared as a whole.
ROUNDS = 1
#: Signatures are hot beyond a share 1 / HOT of all, in a sample of one in SAMPLE documents.
HOT, SAMPLE = 2048, 16
#: The rows of a class are joined in so many parts.
SALTS = 16
#: The sets of a signature are paired if there are so many at most; else they are of one family.
PAIRED = 16


def sets_of(text: pa.Array, n: int):
    """Of each text in turn, its sorted distinct shingle hashes (lower case A-Z)."""
    for block in K.blocks(text):
        h = block.word_hashes(lower=True)
        s = K.mix(K.shingles(h, n))
        first = block.first.tolist()
        for a, b in zip(first[:-1], first[1:], strict=True):
            if b - a >= n:
                yield np.unique(s[a : b - n + 1])
            elif b > a:
                yield np.array([K.whole(h[a:b])], dtype=np.uint64)
            else:
                yield np.empty(0, dtype=np.uint64)


def digest(s: np.ndarray) -> tuple[int, int]:
    d = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def most_apart(size: int, num: int, den: int) -> int:
    """The most elements in which a set of this size and a larger linked one differ."""
    return size * (den - num) // num


def _signs(size: int, num: int, den: int) -> int:
    """How many parts a set of this size signs: a quarter more than can differ and one."""
    most = most_apart(size, num, den) + 1
    return most + most // 4


def needed(size: int, num: int, den: int) -> int:
    """How many signatures of parts a set shares with any linked set, at least; 0 if only an equal set can be linked."""
    least = -(-size * num // den)
    return _signs(least, num, den) - most_apart(least, num, den) if most_apart(size, num, den) else 0


def _bits(size: int, num: int, den: int) -> int:
    """The hash range has 2 to this power parts for sets of this size."""
    signs = _signs(size, num, den)
    return (signs + signs // 6 + 3).bit_length()


def _most_signs(bits: int) -> int:
    """The most parts that a set with this level for its own signs there."""
    signs = ((1 << bits) - 4) * 6 // 7 + 1
    while signs + signs // 6 + 3 >= 1 << bits:
        signs -= 1
    return signs


def signed_set(s: np.ndarray, num: int, den: int) -> tuple[np.ndarray, int]:
    """The signatures of a sorted set, and how many of them it shares with any linked set, at least.

    A set also signs at the levels of the smaller sets that it can be linked with. There are none
    if only an equal set can be linked with it. Of two linked sets, one with as many full parts
    as the smaller one signs is enough for the bound on parts; if neither has, both sign a prefix."""
    n = len(s)
    if not most_apart(n, num, den):
        return np.empty(0, dtype=np.uint64), 0
    least, signs, need = -(-n * num // den), _signs(n, num, den), needed(n, num, den)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(K.mix(s ^ np.uint64(0x5851F42D4C957F2D)))])
    out, few = [], False
    for bits in range(_bits(least, num, den), _bits(n, num, den) + 1):
        edges = np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
        at = np.append(np.searchsorted(s, edges), n)
        full = np.flatnonzero(np.diff(at))[:signs]
        few |= len(full) < min(signs, _most_signs(bits))
        out.append(K.mix(total[at[full + 1]] - total[at[full]] + full.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(bits)))
    if few:
        out.append(K.mix(s[: n - least + 1] ^ np.uint64(0xD6E8FEB86659FD93)))
        need = 1
    return np.concatenate(out), need


def signatures(s: np.ndarray, num: int, den: int) -> np.ndarray:
    """The signatures of a sorted set."""
    return signed_set(s, num, den)[0]


def _signed(df: DataFrame, id_col: str, text: str, n: int, num: int, den: int) -> DataFrame:
    """(id, n_shingles, d1, d2, need, signatures) of every row."""
    def run(batches):
        for batch in batches:
            size, d1, d2, need, sigs = [], [], [], [], []
            for s in sets_of(K.column(batch, "text"), n):
                a, b = digest(s)
                found, least = signed_set(s, num, den)
                size.append(len(s)), d1.append(a), d2.append(b), need.append(least)
                sigs.append(found.view(np.int64))
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in sigs])]).astype(np.int32)
            values = np.concatenate(sigs) if sigs else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(need, pa.int32()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int64()))],
                names=["id", "n_shingles", "d1", "d2", "need", "sigs"],
            )

    return df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(
        K.lean(run), "id long, n_shingles long, d1 long, d2 long, need int, sigs array<long>"
    )


def link(sets: list[np.ndarray], num: int, den: int, cell: np.ndarray | None = None, known: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links (pairs of positions) that connect what the sets' links of num/den connect.

    With ``cell``, only links between sets of different cells are looked for. Sets of one value of ``known`` are
    connected already."""
    n = len(sets)
    size = np.array([len(s) for s in sets], dtype=np.int64)
    end = np.cumsum(size)
    _, token = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(n), size)
    open_ = np.ones(n, dtype=bool)
    while True:  # a set whose shared tokens can't reach the threshold goes, and its tokens with it
        use = open_[owner]
        count = np.bincount(token[use], minlength=int(token.max()) + 1)
        shared = np.bincount(owner[use & (count[token] > 1)], minlength=n)
        still = open_ & (shared * den >= size * num)
        if still.sum() == open_.sum():
            break
        open_ = still
    if open_.sum() < 2:
        return []
    # groups: sets with the same least shared token; shared tokens are those in two open sets
    at = np.flatnonzero(open_[owner] & (count[token] > 1))
    tok, own = token[at], owner[at]
    begin = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
    alive = own[begin]
    least = np.minimum.reduceat(tok, begin)
    _, group_of_alive = np.unique(least, return_inverse=True)
    n_groups = int(group_of_alive.max()) + 1
    group = np.full(n, -1, dtype=np.int64)
    group[alive] = group_of_alive
    smallest, largest = np.full(n_groups, np.iinfo(np.int64).max), np.zeros(n_groups, dtype=np.int64)
    np.minimum.at(smallest, group_of_alive, size[alive])
    np.maximum.at(largest, group_of_alive, size[alive])
    members = [m for m in np.split(alive[np.argsort(group_of_alive, kind="stable")], np.cumsum(np.bincount(group_of_alive))[:-1])]
    # the matrix: for each token, the groups that have it, and in how many sets
    key, held = np.unique(tok * n_groups + group[own], return_counts=True)
    row, col = key // n_groups, key % n_groups
    row_at = np.searchsorted(row, np.arange(int(token.max()) + 2))
    weight = np.add.reduceat(count[tok], begin)  # sets near the middle of a family first
    label = np.arange(n)
    if known is not None:
        _, at, of = np.unique(known, return_index=True, return_inverse=True)
        label = at[of]
    parent = label.tolist()

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    found: list[tuple[int, int]] = []
    done = np.zeros(n, dtype=bool)
    mark = np.zeros(int(token.max()) + 1, dtype=bool)
    stop = np.append(begin[1:], len(tok))
    for k in np.argsort(-weight / size[alive], kind="stable").tolist():
        a = int(alive[k])
        done[a] = True
        mine = tok[begin[k] : stop[k]]
        lengths = row_at[mine + 1] - row_at[mine]
        cells = np.repeat(row_at[mine] - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))
        cells = cells[(col[cells] != group[a]) | (held[cells] > 1)]
        bound = np.bincount(col[cells], minlength=n_groups)
        best = np.clip(bound, smallest, largest)
        common = np.minimum(bound, best)
        to_open = np.flatnonzero(common * den >= num * (size[a] + best - common))
        if not len(to_open):
            continue
        others = np.concatenate([members[g] for g in to_open])
        keep = ~done[others] & (label[others] != label[a]) & (size[others] * den >= size[a] * num) & (size[a] * den >= size[others] * num)
        if cell is not None:
            keep &= cell[others] != cell[a]
        others = others[keep]
        mark[mine] = True
        for part in np.array_split(others, max(1, int(size[others].sum()) >> 21)):
            if not len(part):
                continue
            lengths = size[part]
            places = np.repeat(end[part] - lengths - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))
            both = np.add.reduceat(mark[token[places]].astype(np.int64), np.cumsum(lengths) - lengths)
            for b in part[both * den >= num * (size[a] + lengths - both)].tolist():
                x, y = find(a), find(b)
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    found.append((a, b))
                    label[label == max(x, y)] = min(x, y)
        mark[mine] = False
    return found


def _links(rows: DataFrame, num: int, den: int) -> DataFrame:
    """Verified links (a, b) inside each tile of rows (tile, cell, node, comp, tokens); a null cell means no cells."""
    def solve(held):
        if len(held) < 2 or len({c for *_, c, _ in held}) < 2:
            return
        cell = None if held[0][0] is None else np.array([c for c, *_ in held])
        for x, y in link([np.frombuffer(t, np.uint64) for *_, t in held], num, den, cell, np.array([c for *_, c, _ in held])):
            yield held[x][1], held[y][1]

    def run(batches):
        tile, held = None, []
        for batch in batches:
            out = []
            for t, *rest in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if t != tile:
                    out += solve(held)
                    tile, held = t, []
                held.append(rest)
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["a", "b"])
        out = list(solve(held))
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["a", "b"])

    return rows.repartition("tile").sortWithinPartitions("tile").select("tile", "cell", "node", "comp", "tokens").mapInArrow(K.lean(run), "a long, b long")


def _shared(live: DataFrame) -> DataFrame:
    """(sig, d1) of the signatures that two different sets have.

    One shuffle by signature serves. Signatures that more than a share 1 / HOT of a
    sample has (at most HOT, whatever the table) are taken out of it and counted before the shuffle."""
    rows = live.select("id", F.explode("sigs").alias("sig"), "d1")
    drawn = rows.filter(F.pmod(F.xxhash64("id"), F.lit(SAMPLE)) == 0).groupBy("sig").count()
    total = drawn.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    hot = [(r.sig,) for r in drawn.filter(F.col("count") > max(16, total / HOT)).select("sig").collect()]  # HOT rows at most
    rows, several = rows.drop("id"), []
    same = Window.partitionBy("sig")
    if hot:
        table = F.broadcast(live.sparkSession.createDataFrame(hot, "sig long"))
        ends = rows.join(table, "sig").groupBy("sig").agg(F.min("d1").alias("a"), F.max("d1").alias("z")).collect()  # HOT rows at most
        several = [(r.sig,) for r in ends if r.a < r.z]
    cold = rows.join(table, "sig", "left_anti") if hot else rows
    found = cold.withColumn("a", F.min("d1").over(same)).withColumn("z", F.max("d1").over(same)).filter("a < z").select("sig", "d1")
    if several:
        found = found.union(rows.join(F.broadcast(live.sparkSession.createDataFrame(several, "sig long")), "sig").select("sig", "d1"))
    return found.distinct()


def _core(rows: DataFrame) -> DataFrame:
    """Of rows (sig, set, comp, need), takes out, round by round, sets that share fewer signatures with other
    components than a linked set would, and signatures that then one component has. What is left still has every
    link between components; most sets that only have a passage in common are gone. It ends with a round
    that takes less than a tenth, as fewer rounds only leave more to verify."""
    now, n = stored(rows), -1
    while True:
        rows = now.count()
        if not rows or (n > 0 and rows > 0.9 * n):
            return now
        n = rows
        keep = now.groupBy("set").agg(F.count(F.lit(1)).alias("n"), F.first("need").alias("least")).filter("n >= least").select("set")
        left = now.join(keep, "set", "left_semi")  # a set has few signatures, as its size bounds them
        pairs = left.groupBy("sig").agg(F.min("comp").alias("a"), F.max("comp").alias("z")).filter("a < z")
        later = stored(left.join(apart(pairs, "sig", "a").select("sig"), "sig", "left_semi").select("sig", "set", "comp", "need"))
        drop_stored(now)
        now = later


def _groups(core: DataFrame, sizes: DataFrame) -> DataFrame:
    """(tile, cell, node, comp) of the sets of each group and, in every one of its tiles, the lead.

    core: rows (sig, set, comp, need), where ``set`` is a node. A set goes to the lead of another component with which it shares most."""
    first = core.groupBy("sig").agg(F.min(F.struct("comp", "set")).alias("f")).select("sig", F.col("f.comp").alias("lead_comp"), F.col("f.set").alias("lead"))
    met = core.join(apart(first, "sig", "lead"), "sig").filter("comp <> lead_comp").groupBy("set", "comp", "lead", "lead_comp").count()
    best = met.groupBy("set", "comp").agg(F.max_by(F.struct("lead", "lead_comp"), F.struct("count", "lead")).alias("m")).select(F.col("set").alias("node"), "comp", "m.lead", "m.lead_comp")
    of = stored(best.join(sizes, "node"))
    groups = of.groupBy("lead", "lead_comp").agg(F.least(F.count(F.lit(1)), F.ceil(F.sum("size") / TILE_TOKENS)).cast("int").alias("tiles"))
    leads = groups.select("lead", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("part"), F.col("lead").alias("node"), F.col("lead_comp").alias("comp"))
    followers = of.join(apart(groups.select(F.col("lead").alias("l"), "tiles"), "l", "tiles"), F.col("lead") == F.col("l")).select("lead", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int").alias("part"), "node", "comp")
    return leads.union(followers).select(F.concat_ws("-", "lead", "part").alias("tile"), F.lit(None).cast("int").alias("cell"), "node", "comp")


def _rarest(core: DataFrame, sizes: DataFrame) -> DataFrame:
    """(sig, held, set, comp, need, size) of each set's signatures, from the rarest up, without the last need - 1."""
    held = core.groupBy("sig").agg(F.count(F.lit(1)).alias("held"))
    own = Window.partitionBy("set")  # a set has few signatures, as its size bounds them
    rows = core.join(apart(held, "sig", "held"), "sig").join(sizes, F.col("set") == F.col("node"))
    rows = rows.withColumn("n", F.count(F.lit(1)).over(own)).withColumn("rank", F.row_number().over(own.orderBy("held", "sig")))
    return rows.filter("rank <= n - need + 1").select("sig", "held", "set", "comp", "need", "size")


def _paired(core: DataFrame, rarest: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b): sets of different components that have a signature of few holders among the rarest of both, sizes that can be linked, and as many signatures in common as linked sets."""
    held = rarest.filter(F.col("held") <= PAIRED).groupBy("sig").agg(F.collect_list(F.struct("set", "comp", "need", "size")).alias("m"))  # PAIRED at most
    fit = lambda x, y: (x["set"] < y["set"]) & (x["comp"] != y["comp"]) & (F.least(x["size"], y["size"]) * den >= F.greatest(x["size"], y["size"]) * num)
    pair = lambda x, y: F.struct(x["set"].alias("a"), y["set"].alias("b"), F.greatest(x["need"], y["need"]).alias("least"))
    pairs = held.select(F.explode(F.flatten(F.transform("m", lambda x: F.transform(F.filter("m", lambda y: fit(x, y)), lambda y: pair(x, y))))).alias("p")).select("p.*").distinct()
    signed = core.groupBy("set").agg(F.collect_list("sig").alias("sigs"))
    of = lambda side: signed.select(F.col("set").alias(f"{side}_set"), F.col("sigs").alias(f"{side}_sigs"))
    both = pairs.join(of("a"), F.col("a") == F.col("a_set")).join(of("b"), F.col("b") == F.col("b_set"))
    return both.filter(F.size(F.array_intersect("a_sigs", "b_sigs")) >= F.col("least")).select("a", "b")


def _families(core: DataFrame, sizes: DataFrame, num: int, den: int) -> DataFrame:
    """(tile, cell, node, comp) of what can be linked by its signatures, each two cells of a family in a tile, but for its largest component's."""
    rarest = stored(_rarest(core, sizes))
    frequent = rarest.filter(F.col("held") > PAIRED)
    leads = frequent.groupBy("sig").agg(F.min("set").alias("lead"))
    alike = frequent.join(apart(leads, "sig", "lead"), "sig").filter("set <> lead").select("set", "lead").distinct()
    families = components(_paired(core, rarest, num, den).union(alike), "a", "b").withColumnRenamed("component", "family")
    drop_stored(rarest)
    of = core.select(F.col("set").alias("node"), "comp").distinct().join(families, "node").join(sizes, "node")
    parts = stored(of.groupBy("family", "comp").agg(F.sum("size").alias("size")))
    sums = parts.groupBy("family").agg(F.sum("size").alias("whole"), F.max("size").alias("most"), F.max_by("comp", F.struct("size", "comp")).alias("main"))
    cells = lambda tokens: F.ceil(tokens / CELL_TOKENS).cast("int")
    small = F.col("whole") <= CELL_TOKENS
    weights = sums.select(
        F.col("family").alias("f"), F.when(~small, F.col("main")).alias("main"), F.when(small, 0).otherwise(cells(F.col("most"))).alias("main_cells"),
        F.when(small, 1).otherwise(cells(F.col("whole") - F.col("most"))).alias("rest_cells"),
    )
    of = of.join(apart(weights, "f", "main_cells"), F.col("family") == F.col("f"))
    chosen, mains, rest = F.coalesce(F.col("comp") == F.col("main"), F.lit(False)), F.col("main_cells"), F.col("rest_cells")
    of = of.withColumn("cell", F.when(chosen, F.pmod(F.xxhash64("node"), mains)).otherwise(mains + F.pmod(F.xxhash64("node"), rest)).cast("int"))
    of = of.withColumn("other", F.explode(F.sequence(F.when(chosen, mains).otherwise(0), mains + rest - 1)))
    return of.select(
        F.concat_ws("-", "family", F.least("cell", "other"), F.greatest("cell", "other")).alias("tile"), F.when(F.col("cell") != F.col("other"), F.col("cell")).alias("cell"), "node", "comp"
    )


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text: str = "text", n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(id, n_shingles, component_id): the components of all links num / den and more.

    Documents of fewer than n words have the whole sequence as their one shingle; those
    without words, and null texts, have none and are linked with nothing. A null id
    is linked with nothing and its component is null; rows that share an id count as one document in
    a component, and each gives a row. An empty table gives an empty result. Other columns are ignored.
    """
    if not 0 < num <= den:
        raise ValueError("the similarity must be over 0 and 1 at most")
    whole = stored(_signed(df, id_col, text, n, num, den))
    signed = stored(whole.drop("sigs"))
    live = signed.filter("id IS NOT NULL AND n_shingles > 0")
    classes = stored(live.groupBy("d1", "d2").agg(F.min("id").alias("node"), F.first("n_shingles").alias("size"), F.first("need").alias("need"), F.count(F.lit(1)).alias("rows")))
    needs = classes.groupBy(F.col("d1").alias("set")).agg(F.min("need").alias("need"))
    shared = _shared(whole.filter("id IS NOT NULL")).withColumnRenamed("d1", "set")
    by_hash = _core(shared.join(needs, "set").select("sig", "set", F.col("set").alias("comp"), "need"))
    drop_stored(whole)
    sizes = classes.select("node", "size")
    core = stored(by_hash.join(classes.select("d1", "node"), F.col("set") == F.col("d1")).select("sig", F.col("node").alias("set"), F.col("node").alias("comp"), "need"))
    wanted = classes.join(by_hash.select("set").distinct(), F.col("set") == F.col("d1"), "left_semi").select("node", F.col("d1").alias("e1"), F.col("d2").alias("e2"))
    texts = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text")).join(
        wanted.hint("shuffle_hash"), F.col("id") == F.col("node")
    ).select("text", "node", "e1", "e2")

    def tokens(batches):
        for batch in batches:
            e1, e2 = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            keep, out = [], []
            for i, s in enumerate(sets_of(K.column(batch, "text"), n)):
                if digest(s) == (e1[i], e2[i]):
                    keep.append(i)
                    out.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(1).take(pa.array(keep, pa.int64())), pa.array(out, pa.binary())], names=["own", "tokens"])

    sets = stored(texts.mapInArrow(K.lean(tokens), "own long, tokens binary"))
    drop_stored(by_hash)
    labels = None
    for turn in range(ROUNDS + 1):
        left = core if labels is None else _core(core.drop("comp").join(apart(labels, "node", "component"), F.col("set") == F.col("node"), "left").select("sig", "set", F.coalesce("component", "set").alias("comp"), "need"))
        if left.isEmpty():
            break
        tiles = _groups(left, sizes) if turn < ROUNDS else _families(left, sizes, num, den)
        # the tokens stream past the small table of tiles, unsorted
        links = _links(sets.join(tiles.hint("shuffle_hash"), F.col("own") == F.col("node")).drop("own"), num, den)
        if labels is not None:
            links = links.union(labels.select("node", "component"))
        labels = stored(components(links, "a", "b"))
    drop_stored(sets)
    linked = df.sparkSession.createDataFrame([], "node long, component long") if labels is None else labels
    named = classes.join(linked, "node", "left").select("d1", "d2", "rows", "node", F.coalesce("component", "node").alias("component_id"))
    named = named.filter("rows > 1 OR component_id <> node").select(
        F.col("d1").alias("c1"), F.col("d2").alias("c2"), "component_id", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("c3")
    )
    salted = signed.select("id", "n_shingles", "d1", "d2", F.coalesce(F.pmod(F.xxhash64("id"), F.lit(SALTS)), F.lit(0)).cast("int").alias("d3"))
    joined = salted.join(named, (F.col("d1") == F.col("c1")) & (F.col("d2") == F.col("c2")) & (F.col("d3") == F.col("c3")) & (F.col("n_shingles") > 0), "left")
    return joined.select(
        F.col("id").alias(id_col), "n_shingles", F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id")
    )
