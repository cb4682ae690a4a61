"""Prefix trie of conversations (operator 12).

A conversation is a row of turn ids, cut into panels of ``WIDTH`` columns so that none is unbounded.
Panels are range-partitioned in dictionary order. A shard pads its rows to a matrix, sorts it with
``lexsort`` and marks, column by column, where a row differs from the one above; the marks,
accumulated with OR along the columns, are the starts of nodes, and ``reduceat`` over them sums up
every depth. Only nodes that hold the first or the last row of a shard can go on in another shard:
their parts are recombined, and what they add to their ancestors is added there.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackwork.llm.tables import in_batches, written

#: Turns of a panel, panels of a block of the running sums, rows of a shard, turns that may be borrowed.
WIDTH, BLOCK, SHARD, BORROWED = 64, 1024, 50_000, 3
#: Conversations that borrow from one another: the first of so many ids lends.
FAMILY = 20
#: Copies of a parent, so that many children of one parent meet in several tasks.
SALTS = 64
WORD = r"[^\x20\x09-\x0D]+"
_KEY = ["depth", "k1", "k2"]
_PARTS = (
    "open boolean, depth bigint, k1 bigint, k2 bigint, p1 bigint, p2 bigint, conv bigint, n bigint, words bigint, "
    "ends bigint, kids bigint, leaves bigint, saved bigint, parent bigint, sha string, first bigint, ids string, "
    "up array<struct<depth:bigint,k1:bigint,k2:bigint>>"
)
_STRUCT = pa.struct([("depth", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64())])
_ARROW = {
    "open": pa.bool_(), "sha": pa.string(), "ids": pa.string(), "up": pa.list_(_STRUCT),
}
_NAMES = [field.split()[0] for field in _PARTS.split(", ") if " " in field]


def numbered(messages: DataFrame, conv: str, turn: str, role: str, text: str, shard: int = SHARD) -> DataFrame:
    """(c, pos, a, b, words): turns numbered from 1 in each conversation, their text as a 128-bit id.

    Rows are range-partitioned by conversation and turn, so that a conversation of any length, or any
    number of equal rows, is spread over many tasks; tasks count on, and the counts of earlier tasks are added.
    """
    said = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text)]
    rows = messages.select(F.col(conv).cast("bigint").alias("c"), F.col(turn).alias("t"), said[0].alias("r"), said[1].alias("s"))
    rows = rows.where("c is not null").withColumn("m", F.monotonically_increasing_id())
    parts = max(1, -(-rows.count() // shard))
    order = ["c", F.col("t").asc_nulls_first(), "r", "s", "m"]
    ordered = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    slim = ordered.select(
        "c", F.xxhash64("r", "s").alias("a"), F.xxhash64("s", F.lit(1), "r").alias("b"),
        F.regexp_count("s", F.lit(WORD)).cast("bigint").alias("words"),
    )

    def count(batches):
        part, last, reached = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            own = batch.column(0).to_numpy()
            if not len(own):
                continue
            place = np.arange(len(own))
            starts = np.concatenate([[True], own[1:] != own[:-1]])
            at = place - np.maximum.accumulate(np.where(starts, place, 0)) + 1
            if own[0] == last:
                at[own == last] += reached
            last, reached = own[-1], int(at[-1])
            columns = [batch.column(0), pa.array(np.full(len(own), part), pa.int64()), pa.array(at, pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, *(batch.column(i) for i in (1, 2, 3))], names=["c", "part", "at", "a", "b", "words"])

    schema = "c bigint, part bigint, at bigint, a bigint, b bigint, words bigint"
    turns = written(in_batches(slim).mapInArrow(count, schema), "turns")
    earlier = Window.partitionBy("c").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = turns.groupBy("c", "part").agg(F.max("at").alias("n"))
    sizes = sizes.withColumn("before", F.sum("n").over(earlier)).where("before is not null").select("c", "part", "before")
    turns = turns.join(sizes, ["c", "part"], "left")
    placed = turns.select("c", (F.col("at") + F.coalesce("before", F.lit(0))).alias("pos"), "a", "b", "words")
    return written(placed, "numbered-turns")


def rebuilt(turns: DataFrame) -> DataFrame:
    """(c, d, a, b, words): each conversation's turns, the first ones borrowed; also a row with d = 0 for each."""
    share = (F.crc32(F.col("c").cast("string")) % (BORROWED + 1)).cast("int")
    first = turns.where(F.col("pos") <= BORROWED)
    heads = first.groupBy("c").agg(F.array_sort(F.collect_list(F.struct("pos", "a", "b", "words"))).alias("head"))
    lent = heads.select(F.col("c").alias("base"), "head")
    convs = heads.select("c", share.alias("h"), (F.col("c") - F.col("c") % FAMILY).alias("base")).join(lent, "base", "left")
    borrowed = F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.array().cast("array<struct<pos:bigint,a:bigint,b:bigint,words:bigint>>"))
    convs = convs.select("c", borrowed.alias("head"))
    taken = convs.select("c", F.posexplode("head")).select("c", (F.col("pos") + 1).cast("bigint").alias("d"), "col.a", "col.b", "col.words")
    own = turns.withColumn("h", share).where("pos > h").join(convs.select("c", F.size("head").alias("k")), "c")
    own = own.select("c", (F.col("pos") - F.col("h") + F.col("k")).alias("d"), "a", "b", "words")
    zero = F.lit(0).cast("bigint")
    return own.unionByName(taken).unionByName(convs.select("c", zero.alias("d"), zero.alias("a"), zero.alias("b"), zero.alias("words")))


def running(rows: DataFrame, values: dict[str, Column], aggregate, later: bool) -> DataFrame:
    """Aggregate of each value over the earlier (or later) panels of a conversation, 0 if there are none.

    Within blocks of panels first, then over the blocks, so that no window holds a long conversation.
    """
    order = lambda c: F.col(c).desc() if later else F.col(c)
    before = lambda *keys: Window.partitionBy(*keys[:-1]).orderBy(order(keys[-1])).rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("c", "block").agg(*(aggregate(v).alias(f"_{n}") for n, v in values.items()), F.lit(1).alias("_one"))
    blocks = blocks.select("c", "block", *(aggregate(f"_{n}").over(before("c", "block")).alias(f"_{n}") for n in values))
    blocks = blocks.where(" or ".join(f"_{n} is not null" for n in values))
    inside = rows.withColumns({n: aggregate(v).over(before("c", "block", "panel")) for n, v in values.items()})
    joined = inside.join(blocks, ["c", "block"], "left")
    add = (lambda x, y: x + y) if later else (lambda x, y: x.bitwiseXOR(y))
    both = {n: add(F.coalesce(n, F.lit(0)), F.coalesce(f"_{n}", F.lit(0))) for n in values}
    return joined.withColumns(both).drop(*(f"_{n}" for n in values))


def panels(turns: DataFrame, width: int, block: int) -> DataFrame:
    """(c, panel, block, h1, h2, ids, words, goes_on): a row for each conversation and ``width`` turns.

    A turn's id hashes its place, too; a prefix is known by the XOR of its turns' ids, so h1, h2 are the
    key of the prefix before the panel. Ids and keys have 128 bits and are taken for unequal where texts are.
    """
    d, panel = F.col("d"), F.greatest(F.col("d") - 1, F.lit(0))
    rows = turns.withColumn("panel", F.floor(panel / width)).withColumn("block", F.floor(F.col("panel") / block))
    i1, i2 = F.xxhash64("d", "a", "b"), F.xxhash64("b", "a", "d", F.lit(7))
    turn = F.when(d > 0, F.struct("d", i1.alias("a"), i2.alias("b"), "words"))
    own = [F.coalesce(F.bit_xor(F.when(d > 0, i)), F.lit(0)).alias(f"x{n}") for n, i in enumerate((i1, i2), 1)]
    grouped = rows.groupBy("c", "block", "panel").agg(F.array_sort(F.collect_list(turn)).alias("turns"), *own)
    # Both running sums read it twice; as a table it is planned and kept in the driver once.
    grouped = written(grouped, "turn-panels")
    grouped = running(grouped, {"h1": F.col("x1"), "h2": F.col("x2")}, F.bit_xor, later=False)
    grouped = running(grouped, {"rest": F.lit(1)}, F.sum, later=True)
    pair = lambda t: F.struct(t["a"].alias("a"), t["b"].alias("b"))
    return grouped.select("c", "panel", "block", "h1", "h2", F.transform("turns", pair).alias("ids"), F.col("turns.words").alias("words"), (F.col("rest") > 0).alias("goes_on"))


class Rows:
    """Panels as padded matrices: turn ids (0 beyond the end), keys of all prefixes, words."""

    def __init__(self, table: pa.Table):
        self.c, self.panel, h1, h2 = (table.column(n).to_numpy() for n in ("c", "panel", "h1", "h2"))
        self.head = np.stack([h1, h2])
        ids = pa.concat_arrays(table.column("ids").chunks)
        lengths = np.diff(ids.offsets.to_numpy())
        width = int(lengths.max(initial=0))
        row = np.repeat(np.arange(len(lengths)), lengths)
        column = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        flat = ids.flatten()
        # Where the conversation ends: nowhere in a panel that has a next one.
        self.end = np.where(table.column("goes_on").to_numpy(), -1, lengths)
        self.ids = np.zeros((2, len(lengths), width), dtype=np.int64)
        self.words = np.zeros((len(lengths), width), dtype=np.int64)
        for side, name in enumerate("ab"):
            self.ids[side, row, column] = flat.field(name).to_numpy()
        self.words[row, column] = pa.concat_arrays(table.column("words").chunks).flatten().to_numpy()
        self.keys = np.bitwise_xor.accumulate(self.ids, axis=2) ^ self.head[:, :, None]
        # Turn ids by their rank, -1 beyond the end: the padded matrix.
        first, second = self.ids[:, row, column]
        order = np.lexsort((second, first))
        new = np.ones(len(order), dtype=bool)
        new[1:] = (first[order][1:] != first[order][:-1]) | (second[order][1:] != second[order][:-1])
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.cumsum(new) - 1
        self.matrix = np.full((len(lengths), width), -1, dtype=np.int64)
        self.matrix[row, column] = rank

    def take(self, order: np.ndarray) -> None:
        self.c, self.panel, self.end, self.words, self.matrix = (x[order] for x in (self.c, self.panel, self.end, self.words, self.matrix))
        self.head, self.keys = self.head[:, order], self.keys[:, order]


def shard_nodes(table: pa.Table, panel_width: int = WIDTH) -> pa.RecordBatch:
    """Nodes of a shard's rows; nodes that hold its first or last row are open, and parts of a whole."""
    rows = Rows(table)
    width = rows.matrix.shape[1]
    rows.take(np.lexsort((rows.c, rows.end < 0, *(rows.matrix[:, j] for j in range(width - 1, -1, -1)), rows.head[1], rows.head[0], rows.panel)))
    size, c = len(rows.c), rows.c
    changed = np.ones((size, width + 1), dtype=bool)
    changed[1:, 0] = (rows.panel[1:] != rows.panel[:-1]) | (rows.head[:, 1:] != rows.head[:, :-1]).any(axis=0)
    changed[1:, 1:] = rows.matrix[1:] != rows.matrix[:-1]
    starts = np.logical_or.accumulate(changed, axis=1)
    out = {name: [] for name in _NAMES}
    none = hashlib.sha256(b"").hexdigest()
    depth0 = rows.panel * panel_width

    def path(row: int, upto: int) -> list:
        """The node in column ``upto`` and those above it in its panel; in the first panel the root, too."""
        above = [] if rows.panel[row] else [{"depth": 0, "k1": 0, "k2": 0}]
        return above + [{"depth": int(depth0[row]) + j + 1, "k1": int(rows.keys[0, row, j]), "k2": int(rows.keys[1, row, j])} for j in range(upto + 1)]

    # From the root down: segments of equal prefix, those beyond a row's end left out later.
    found, conv_above, known_above = [], None, None
    for j in range(width):
        at = np.flatnonzero(starts[:, j + 1])
        n = np.diff(np.append(at, size))
        smallest = np.minimum.reduceat(c, at)
        ends = np.add.reduceat((rows.end == j + 1).astype(np.int64), at)
        real = rows.matrix[at, j] >= 0
        opened = (at == 0) | (at + n == size)
        parent = np.where(known_above[at], conv_above[at], 0) if j else np.zeros(len(at), dtype=np.int64)
        known = known_above[at] if j else np.zeros(len(at), dtype=bool)
        conv_above, known_above = np.repeat(smallest, n), np.repeat(~opened, n)
        found.append((at, n, smallest, ends, real, opened, parent, known))
    # From the leaves up: what closed nodes count for stands at their first row, and nodes add up their rows.
    leaves, saved, kids = (np.zeros(size, dtype=np.int64) for _ in range(3))
    for j in range(width - 1, -1, -1):
        at, n, smallest, ends, real, opened, parent, known = found[j]
        words = rows.words[at, j]
        closed = real & ~opened
        children = np.add.reduceat(kids, at)
        np.add.at(leaves, at[closed], (ends == n)[closed].astype(np.int64))
        np.add.at(saved, at[closed], ((n - 1) * words)[closed])
        kids = np.zeros(size, dtype=np.int64)
        kids[at[closed]] = 1
        sums = (np.add.reduceat(leaves, at), np.add.reduceat(saved, at))
        above = rows.keys[:, at, j - 1] if j else rows.head[:, at]
        values = dict(depth=depth0[at] + j + 1, k1=rows.keys[0, at, j], k2=rows.keys[1, at, j], p1=above[0], p2=above[1], conv=smallest, n=n)
        values |= dict(words=words, ends=ends, kids=children, leaves=sums[0], saved=sums[1])
        for name, value in values.items():
            out[name].append(value[real])
        out["open"].append(opened[real])
        out["parent"] += [p if k else None for p, k in zip(parent[real].tolist(), known[real].tolist())]
        for start, e, is_open in zip(at[real].tolist(), ends[real].tolist(), opened[real].tolist()):
            ids = ",".join(map(str, c[start : start + e].tolist()))
            out["sha"].append(None if is_open else hashlib.sha256(ids.encode()).hexdigest() if e else none)
            out["first"].append(int(c[start]) if is_open and e else None)
            out["ids"].append(ids if is_open and e else None)
            out["up"].append(path(start, j) if is_open else None)
    if (top := int((rows.panel == 0).sum())):
        turnless = int((rows.end[:top] == 0).sum())
        ids = ",".join(map(str, c[:turnless].tolist()))
        values = dict(open=True, depth=0, k1=0, k2=0, p1=0, p2=0, conv=int(c[:top].min()), n=top, words=0, ends=turnless)
        values |= dict(kids=int(kids[:top].sum()), leaves=int(leaves[:top].sum()), saved=int(saved[:top].sum()))
        for name, value in values.items():
            out[name].append(np.array([value]))
        out["parent"].append(None)
        out["sha"].append(None)
        out["first"].append(int(c[0]) if turnless else None)
        out["ids"].append(ids if turnless else None)
        out["up"].append([{"depth": 0, "k1": 0, "k2": 0}])
    columns = []
    for name in _NAMES:
        whole = out[name]
        if whole and isinstance(whole[0], np.ndarray):
            whole = np.concatenate(whole)
        columns.append(pa.array(whole, _ARROW.get(name, pa.int64())))
    return pa.RecordBatch.from_arrays(columns, names=_NAMES)


def _hashed_ends(opened: DataFrame) -> DataFrame:
    """(key, sha) of open nodes: the lists of their parts follow each other, and a task reads them as a stream.

    SHA-256 is sequential, so one node's list is read by one task, a part at a time.
    """
    parts = opened.where("ids is not null").select(*_KEY, "first", "ids")
    ordered = parts.repartition(*_KEY).sortWithinPartitions(*_KEY, "first")

    def digest(batches):
        key, state = None, None
        for batch in batches:
            done = []
            for *own, _, ids in zip(*(column.to_pylist() for column in batch.columns)):
                if own != key:
                    if key is not None:
                        done.append((*key, state.hexdigest()))
                    key, state = own, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield rows(done)
        if key is not None:
            yield rows([(*key, state.hexdigest())])

    def rows(done):
        columns = list(zip(*done)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(x, pa.string() if i == 3 else pa.int64()) for i, x in enumerate(columns)], names=[*_KEY, "sha"])

    return in_batches(ordered).mapInArrow(digest, "depth bigint, k1 bigint, k2 bigint, sha string")


def _recombined(opened: DataFrame, width: int) -> DataFrame:
    """Open nodes made whole: parts added, then what they count for added to their ancestors in the panel."""
    whole = opened.groupBy(*_KEY).agg(
        F.first("p1").alias("p1"), F.first("p2").alias("p2"), F.min("conv").alias("conv"), F.sum("n").alias("n"),
        F.first("words").alias("words"), *(F.sum(x).alias(x) for x in ("ends", "kids", "leaves", "saved")), F.first("up").alias("up"),
    )
    whole = written(whole.join(_hashed_ends(opened), _KEY, "left"), "open-nodes")
    own = whole.withColumns({"leaf": (F.col("ends") == F.col("n")).cast("bigint"), "gain": (F.col("n") - 1) * F.col("words")})
    more = own.select(F.explode("up").alias("u"), "leaf", "gain").groupBy("u").agg(F.sum("leaf").alias("leaf"), F.sum("gain").alias("gain"))
    more = more.select("u.*", "leaf", "gain")
    inside = F.col("depth") > 0
    same_panel = (F.col("depth") - 1) % width > 0
    # A child in the next panel is counted with that panel.
    kids = whole.where(inside & (same_panel | (F.col("depth") == 1)))
    kids = kids.groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count(F.lit(1)).alias("born"))
    full = whole.join(more, _KEY, "left").join(kids, _KEY, "left")
    add = lambda x, y: (F.col(x) + F.coalesce(y, F.lit(0))).alias(x)
    sha = F.coalesce("sha", F.sha2(F.lit(b""), 256))
    return full.select(
        *_KEY, "p1", "p2", "conv", "n", "ends", add("kids", "born"), add("leaves", "leaf"), add("saved", "gain"),
        F.lit(None).cast("bigint").alias("parent"), sha.alias("sha"),
    )


def _named(nodes: DataFrame, whole: DataFrame) -> DataFrame:
    """``nodes`` with the conversation of each one's parent, where the shard did not know it."""
    salt = F.pmod(F.xxhash64(*_KEY), F.lit(SALTS))
    above = whole.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv").alias("elder"))
    above = above.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    orphan = nodes.where("parent is null").withColumn("salt", salt)
    found = orphan.join(above, ["depth", "p1", "p2", "salt"], "left").withColumn("parent", F.col("elder")).drop("salt", "elder")
    return nodes.where("parent is not null").unionByName(found)


def _from_later_panels(nodes: DataFrame, rows: DataFrame, width: int) -> DataFrame | None:
    """(key, kids, leaves, saved) that later panels add to nodes of earlier ones; None without later panels."""
    tops = nodes.where((F.col("depth") > 1) & ((F.col("depth") - 1) % width == 0))
    heads = tops.groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2"), F.col("parent").alias("c"))
    heads = written(heads.agg(F.count(F.lit(1)).alias("kids"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")), "panel-heads")
    if heads.isEmpty():
        return None
    # The smallest member of a prefix stands for it: its panels are the path up to the root.
    totals = heads.select("c", (F.floor(F.col("depth") / width) - 1).alias("panel"), "leaves", "saved")
    path = rows.join(heads.select("c").distinct(), "c", "left_semi").join(totals, ["c", "panel"], "left")
    path = written(path, "panel-paths")
    later = running(path, {"l": F.col("leaves"), "s": F.col("saved")}, F.sum, later=True)
    sums = {"l": F.col("l") + F.coalesce("leaves", F.lit(0)), "s": F.col("s") + F.coalesce("saved", F.lit(0))}
    carrying = later.withColumns(sums).where("l > 0 or s > 0").select("c", "panel", "h1", "h2", "ids", "words", "goes_on", "l", "s")

    def spread(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            table = Rows(pa.Table.from_batches([batch]))
            l, s = (batch.column(n).to_numpy() for n in ("l", "s"))
            row, column = np.nonzero(table.matrix >= 0)
            root = np.flatnonzero(table.panel == 0)
            depth = np.concatenate([table.panel[row] * width + column + 1, np.zeros(len(root), dtype=np.int64)])
            keys = [np.concatenate([k[row, column], np.zeros(len(root), dtype=np.int64)]) for k in table.keys]
            owner = np.concatenate([row, root])
            columns = [depth, *keys, l[owner], s[owner]]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=[*_KEY, "leaves", "saved"])

    schema = "depth bigint, k1 bigint, k2 bigint, leaves bigint, saved bigint"
    sums = in_batches(carrying).mapInArrow(spread, schema).withColumn("kids", F.lit(0).cast("bigint"))
    both = sums.unionByName(heads.select(*_KEY, F.lit(0).cast("bigint").alias("leaves"), F.lit(0).cast("bigint").alias("saved"), "kids"))
    return both.groupBy(*_KEY).agg(*(F.sum(x).alias(f"later_{x}") for x in ("kids", "leaves", "saved")))


def prefix_trie(
    messages: DataFrame,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    width: int = WIDTH,
    shard: int = SHARD,
    block: int = BLOCK,
) -> DataFrame:
    """Nodes of the trie of rebuilt conversations.

    Turns are ordered by ``turn`` (null first), equal ones by role, then text; a null role or text is
    empty, repeated rows are turns of their own. Conversation ``c`` is rebuilt from the first ``h`` turns of
    ``c - c % 20`` and its own turns after its first ``h``, with ``h = crc32(c) % 4`` (``%`` keeps the sign of
    ``c``). Returns per distinct sequence of first ``depth`` turns: conv_id (smallest member), depth,
    parent_conv_id (null at the root), n_convs, n_children, n_leaves, saved_tokens and ends_sha256 (of the
    members that end there). Rows without a conversation id take no part; an empty table has no nodes,
    not even a root; other columns are not read. Conversations may be of any length: ``width`` (turns of a
    panel), ``shard`` (rows of a task) and ``block`` (panels of a running sum) bound memory, not results.
    """
    rows = written(panels(rebuilt(numbered(messages, conv, turn, role, text, shard)), width, block), "panels")
    shards = max(1, -(-rows.count() // shard))
    ranged = rows.select("panel", "h1", "h2", "ids", "c", "words", "goes_on").repartitionByRange(shards, "panel", "h1", "h2", "ids", "goes_on", "c")

    def collect(batches):
        held = [b for b in batches if b.num_rows]
        if held:
            nodes = shard_nodes(pa.Table.from_batches(held), width)
            for start in range(0, nodes.num_rows, 10_000):
                yield nodes.slice(start, 10_000)

    parts = written(in_batches(ranged).mapInArrow(collect, _PARTS), "node-parts")
    whole = written(_recombined(parts.where("open"), width), "whole-nodes")
    closed = parts.where("not open").select(*whole.columns)
    # Heads of later panels are closed or whole nodes of the last column.
    elders = whole.unionByName(closed.where(F.col("depth") % width == 0))
    nodes = written(_named(closed.unionByName(whole), elders), "nodes")
    later = _from_later_panels(nodes, rows, width)
    if later is not None:
        nodes = nodes.join(later, _KEY, "left")
        nodes = nodes.withColumns({x: F.col(x) + F.coalesce(f"later_{x}", F.lit(0)) for x in ("kids", "leaves", "saved")})
    return nodes.select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.col("kids").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.col("sha").alias("ends_sha256"),
    )


#: The same nodes in DuckDB SQL; crc32 is spelt out byte by byte.
TRIE_SQL = """
WITH turns AS (
    SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS s,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
    FROM conversations WHERE conv_id IS NOT NULL
), digits AS (
    SELECT DISTINCT c, CAST(c AS VARCHAR) AS w FROM turns
), shape AS (
    SELECT c, c - c % 20 AS base,
           xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(w) + 1), lambda i: ascii(w[i])::BIGINT)),
               lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)), lambda x, k: xor(x >> 1, (x & 1) * 3988292384))),
               4294967295::BIGINT) % 4 AS h
    FROM digits
), rebuilt AS (
    SELECT s.c, t.pos AS place, {'r': t.r, 's': t.s} AS said FROM shape s JOIN turns t ON t.c = s.base AND t.pos <= s.h
    UNION ALL
    SELECT t.c, 3 + t.pos, {'r': t.r, 's': t.s} FROM turns t JOIN shape s ON s.c = t.c AND t.pos > s.h
), whole AS (
    SELECT s.c, coalesce(q.seq, []) AS seq
    FROM shape s LEFT JOIN (SELECT c, list(said ORDER BY place) AS seq FROM rebuilt GROUP BY c) q ON q.c = s.c
), prefixes AS (
    SELECT c, unnest(range(0, len(seq) + 1)) AS d, seq FROM whole
), nodes AS (
    SELECT d, seq[:d] AS p, min(c) AS conv, count(*) AS n,
           coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (len(seq) = d), '') AS ids,
           bool_and(len(seq) = d) AS leaf
    FROM prefixes GROUP BY d, seq[:d]
), counted AS (
    SELECT *, CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(p[d].s, '[^\\x20\\x09-\\x0D]+')) END AS words FROM nodes
), under AS (
    SELECT e.d AS d, seqs.p AS p, sum(CASE WHEN x.leaf THEN 1 ELSE 0 END) AS leaves, sum((x.n - 1) * x.words) AS saved,
           sum(CASE WHEN x.d = e.d + 1 THEN 1 ELSE 0 END) AS kids
    FROM counted x, LATERAL (SELECT unnest(range(0, x.d + 1)) AS d) e, LATERAL (SELECT x.p[:e.d] AS p) seqs
    GROUP BY e.d, seqs.p
)
SELECT n.conv AS conv_id, n.d AS depth, up.conv AS parent_conv_id, n.n AS n_convs, CAST(u.kids AS BIGINT) AS n_children,
       CAST(u.leaves AS BIGINT) AS n_leaves, CAST(u.saved AS BIGINT) AS saved_tokens, sha256(n.ids) AS ends_sha256
FROM counted n JOIN under u ON u.d = n.d AND u.p = n.p LEFT JOIN nodes up ON up.d = n.d - 1 AND up.p = n.p[:n.d - 1]
"""
