"""Words from characters and tables from ruled lines, for pages whose parser gives no more than these.

chars(keys, char_no, text, x0, x1, top, bottom, size) and rulings(keys, ruling_no, x0, top, x1, bottom); keys name a page.
Everything is within a page: a shuffle by page, then windows or one page's rulings in a task.

Words: characters whose tops differ by at most Y_GAP from the one before, sorted by top, are one line; within a line, in
order of x0, a blank ends a word, and so does a gap of over X_GAP, a character that lies before the last one, or another size
of letters if that is asked for.

Tables: rulings that are thin boxes become horizontal and vertical edges, boxes with area become their four sides. Edges in
nearly the same place are snapped to their mean, and those on one line that touch or nearly do are joined; short ones go.
Where a horizontal and a vertical edge meet is a corner. A cell is the least rectangle between four corners whose sides lie
on edges; cells that share a corner are one table.
"""

from __future__ import annotations

import bisect
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

X_GAP, Y_GAP = 3.0, 3.0
SNAP, JOIN, SHORT, MEET = 3.0, 3.0, 3.0, 3.0
#: A box at most so thick is a drawn line.
THICK = 1.0


def words(chars: DataFrame, keys: tuple[str, ...], x_gap: float = X_GAP, y_gap: float = Y_GAP, by_size: bool = True) -> DataFrame:
    """(keys, word_no, text, x0, top, x1, bottom, size): words line by line; word_no counts a page's words from 0. size is that of the word's first character, and with by_size a word has one size."""
    page = Window.partitionBy(*keys)
    down = page.orderBy("top", "char_no")
    rows = chars.withColumn("_new", F.coalesce((F.col("top") - F.lag("top").over(down) > y_gap).cast("int"), F.lit(0)))
    rows = rows.withColumn("_line", F.sum("_new").over(down.rowsBetween(Window.unboundedPreceding, 0)))
    along = Window.partitionBy(*keys, "_line").orderBy("x0", "char_no")
    blank = F.trim("text") == ""
    before = lambda c: F.lag(c).over(along)
    apart = (F.col("x0") > before("x1") + x_gap) | (F.col("x0") < before("x0")) | before(blank)
    if by_size:
        apart = apart | (F.col("size") != before("size"))
    rows = rows.withColumn("_opens", F.coalesce(apart, F.lit(True)).cast("int"))
    rows = rows.withColumn("_word", F.sum("_opens").over(along.rowsBetween(Window.unboundedPreceding, 0))).where(~blank)
    item = F.struct("x0", "char_no", "text", "size")
    found = rows.groupBy(*keys, "_line", "_word").agg(F.array_sort(F.collect_list(item)).alias("_c"), F.min("x0").alias("x0"), F.min("top").alias("top"), F.max("x1").alias("x1"), F.max("bottom").alias("bottom"))
    number = F.row_number().over(page.orderBy("_line", "_word")) - 1
    return found.select(*keys, number.alias("word_no"), F.array_join(F.transform("_c", lambda c: c["text"]), "").alias("text"), "x0", "top", "x1", "bottom", F.col("_c")[0]["size"].alias("size"))


def snapped(values: list[float], gap: float = SNAP) -> dict[float, float]:
    """Each value and the mean of its cluster: sorted values no further apart than gap from the one before."""
    out: dict[float, float] = {}
    cluster: list[float] = []
    for v in [*sorted(values), None]:
        if cluster and (v is None or v - cluster[-1] > gap):
            mean = sum(cluster) / len(cluster)
            out.update(dict.fromkeys(cluster, mean))
            cluster = []
        if v is not None:
            cluster.append(v)
    return out


def joined(edges: list[tuple[float, float, float]], gap: float = JOIN, short: float = SHORT) -> list[tuple[float, float, float]]:
    """Edges (place, from, to) on the same place joined where they overlap or nearly touch; those that stay short go."""
    places = snapped([p for p, _, _ in edges])
    out: list[list[float]] = []
    for p, a, z in sorted((places[p], a, z) for p, a, z in edges):
        if out and out[-1][0] == p and a <= out[-1][2] + gap:
            out[-1][2] = max(out[-1][2], z)
        else:
            out.append([p, a, z])
    return [(p, a, z) for p, a, z in out if z - a >= short]


def edges_of(rulings: list[tuple[float, float, float, float]]) -> tuple[list, list]:
    """Horizontal edges (y, x from, x to) and vertical ones (x, y from, y to) of boxes (x0, top, x1, bottom)."""
    flat, upright = [], []
    for x0, top, x1, bottom in rulings:
        x0, x1, top, bottom = min(x0, x1), max(x0, x1), min(top, bottom), max(top, bottom)
        thin, low = x1 - x0 <= THICK, bottom - top <= THICK
        if low and not thin:
            flat.append(((top + bottom) / 2, x0, x1))
        elif thin and not low:
            upright.append(((x0 + x1) / 2, top, bottom))
        elif not thin:
            flat += [(top, x0, x1), (bottom, x0, x1)]
            upright += [(x0, top, bottom), (x1, top, bottom)]
    return joined(flat), joined(upright)


def cells(flat: list, upright: list) -> list[tuple[float, float, float, float]]:
    """Rectangles (x0, top, x1, bottom) between corners, each the least from its upper left corner."""
    # on each line, its corners in order, and whether two of them lie on one edge
    across: dict[float, list[tuple[float, int]]] = defaultdict(list)
    down: dict[float, list[tuple[float, int]]] = defaultdict(list)
    for i, (y, a, z) in enumerate(flat):
        for j, (x, t, b) in enumerate(upright):
            if a - MEET <= x <= z + MEET and t - MEET <= y <= b + MEET:
                across[y].append((x, i))
                down[x].append((y, j))
    for lines in (across, down):
        for corners in lines.values():
            corners.sort()
    on_flat = {(x, y): {i for v, i in across[y] if v == x} for y in across for x, _ in across[y]}
    on_upright = {(x, y): {j for v, j in down[x] if v == y} for x in down for y, _ in down[x]}
    out = []
    for x0, y0 in on_flat:
        right = [x for x, _ in across[y0][bisect.bisect_right(across[y0], (x0, len(flat))) :] if on_flat[x, y0] & on_flat[x0, y0]]
        below = [y for y, _ in down[x0][bisect.bisect_right(down[x0], (y0, len(upright))) :] if on_upright[x0, y] & on_upright[x0, y0]]
        found = next(((x0, y0, x, y) for y in below for x in right if (x, y) in on_flat and on_flat[x, y] & on_flat[x0, y] and on_upright[x, y] & on_upright[x, y0]), None)
        if found:
            out.append(found)
    return out


def tables_of(rulings: list[tuple[float, float, float, float]]) -> list[tuple[float, float, float, float, int]]:
    """Boxes (x0, top, x1, bottom) and numbers of cells of a page's tables, by top, then x0: cells that share a corner, of which there are at least two."""
    found = sorted(set(cells(*edges_of(rulings))))
    over = list(range(len(found)))

    def top(i: int) -> int:
        while over[i] != i:
            over[i] = over[over[i]]
            i = over[i]
        return i

    at: dict[tuple[float, float], int] = {}
    for i, (x0, y0, x1, y1) in enumerate(found):
        for corner in ((x0, y0), (x1, y0), (x0, y1), (x1, y1)):
            over[top(i)] = top(at.setdefault(corner, i))
    groups = defaultdict(list)
    for i, c in enumerate(found):
        groups[top(i)].append(c)
    out = [(min(c[0] for c in g), min(c[1] for c in g), max(c[2] for c in g), max(c[3] for c in g), len(g)) for g in groups.values() if len(g) > 1]
    return sorted(out, key=lambda t: (t[1], t[0]))


def tables(rulings: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, table_no, x0, top, x1, bottom, n_cells): tables that a page's ruled lines make. A page's rulings meet in one Arrow row."""
    box = F.struct(*[F.col(c).cast("double").alias(c) for c in ("x0", "top", "x1", "bottom")])
    pages = rulings.where("x0 IS NOT NULL AND x1 IS NOT NULL AND top IS NOT NULL AND bottom IS NOT NULL").groupBy(*keys).agg(F.array_sort(F.collect_list(box)).alias("boxes"))
    schema = ", ".join(f"`{k}` {rulings.schema[k].dataType.simpleString()}" for k in keys) + ", table_no int, x0 double, top double, x1 double, bottom double, n_cells int"

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                for i, t in enumerate(tables_of([(x["x0"], x["top"], x["x1"], x["bottom"]) for x in r[-1]])):
                    rows.append((*r[:-1], i, *t))
            yield pd.DataFrame(rows, columns=[*keys, "table_no", "x0", "top", "x1", "bottom", "n_cells"])

    return pages.mapInPandas(find, schema)
