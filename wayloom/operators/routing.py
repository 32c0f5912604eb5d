"""Travel over the terrain grid.

The grid is dealt into square blocks. A search keeps, for each origin and block that it has reached, the least (weighted
miles, miles) of the cells; a superstep settles the blocks that received offers, and offers what improved on their
borders to the blocks next to them, until nothing improves or all goals are cheaper than what is left. A task holds one
block for a few origins, as arrays.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scratch import checkpoint
from .raster import CODES, LAND_COST, STRETCH, Grid, labelled_runs

#: Modes of travel, miles a day, the factor of ground without a road, and what stops them.
MODES = {
    "foot": {"miles_per_day": 20.0, "off_road": 1.0, "impassable": ()}, "horse": {"miles_per_day": 35.0, "off_road": 1.0, "impassable": ()},
    "carriage": {"miles_per_day": 20.0, "off_road": 1.9, "impassable": ("swamp", "mountain")},
    "dragon": {"miles_per_day": 500.0, "flies": True}, "ship": {"miles_per_day": 120.0, "sails": True},
}
#: How many cells a journey's end may lie from passable ground or water.
SNAP_RADIUS = {"land": 24, "sea": 5}
BLOCK = 256


def costs(mode: str) -> dict[int, float]:
    """Cost of a mile by class code; classes that are not listed cannot be entered."""
    m = MODES[mode]
    if m.get("sails"):
        return {CODES["ocean"]: 1.0}
    off = m.get("off_road", 1.0)
    return {CODES[c]: cost * (1.0 if c == "road" else off) for c, cost in LAND_COST.items() if c not in m.get("impassable", ())}


def passable(mode: Column, cls: Column) -> Column:
    out = F.lit(False)
    for name, m in MODES.items():
        if not m.get("flies"):
            out = F.when(mode == name, cls.isin(*costs(name))).otherwise(out)
    return out


def move_cost(mode: Column, cls: Column) -> Column:
    """Cost of a mile into a cell; null where the mode cannot go."""
    out = F.lit(None).cast("double")
    for name, m in MODES.items():
        if not m.get("flies"):
            for code, cost in costs(name).items():
                out = F.when((mode == name) & (cls == code), cost).otherwise(out)
    return out


def ring_offsets(radius: int) -> list[tuple[int, int]]:
    """Offsets by growing square rings, the cell itself first; in a ring, by columns its top and bottom sides, then by rows its left and right."""
    out = [(0, 0)]
    for r in range(1, radius + 1):
        out += [(dx, dy) for dx in range(-r, r + 1) for dy in (-r, r)]
        out += [(dx, dy) for dy in range(1 - r, r) for dx in (-r, r)]
    return out


def snap_cell(ends: DataFrame, cells: DataFrame) -> DataFrame:
    """ends (k, mode, cx, cy) with sx, sy: the first passable cell by ring_offsets(); null if there is none in reach."""
    open_cells = cells.select(F.col("cx").alias("sx"), F.col("cy").alias("sy"), "cls")
    spark = ends.sparkSession
    rings = ring_offsets(max(SNAP_RADIUS.values()))  # a fixed table of some 2400 rows
    offsets = F.broadcast(spark.createDataFrame([(i, dx, dy) for i, (dx, dy) in enumerate(rings)], "rank int, dx int, dy int"))
    sails = F.col("mode").isin(*(n for n, m in MODES.items() if m.get("sails")))
    reach = F.when(sails, SNAP_RADIUS["sea"]).otherwise(SNAP_RADIUS["land"])
    own = ends.join(open_cells, (F.col("cx") == F.col("sx")) & (F.col("cy") == F.col("sy")), "left")
    own = own.withColumn("ok", F.coalesce(passable(F.col("mode"), F.col("cls")), F.lit(False)))
    missed = own.where("NOT ok").select("k", "mode", "cx", "cy")
    spread = missed.join(offsets, F.greatest(F.abs("dx"), F.abs("dy")) <= reach).select("k", "mode", "rank", (F.col("cx") + F.col("dx")).alias("sx"), (F.col("cy") + F.col("dy")).alias("sy"))
    met = spread.join(open_cells, ["sx", "sy"]).where(passable(F.col("mode"), F.col("cls")))
    best = met.groupBy("k", "mode").agg(F.min(F.struct("rank", "sx", "sy")).alias("b")).select("k", "mode", F.col("b.sx").alias("bx"), F.col("b.sy").alias("by"))
    out = own.join(best, ["k", "mode"], "left")
    hit = lambda a, b: F.when(F.col("ok"), F.col(a)).otherwise(F.col(b))
    return out.select(*ends.columns, hit("sx", "bx").alias("sx"), hit("sy", "by").alias("sy"))


def fly_route(x1: Column, y1: Column, x2: Column, y2: Column, miles_per_degree: float, miles_per_day: float) -> Column:
    miles = F.hypot(x2 - x1, y2 - y1) * miles_per_degree
    return F.struct(miles.alias("miles"), (miles / miles_per_day).alias("days"))


def component_labels(cells: DataFrame) -> DataFrame:
    """(mode, cy, xa, xb, label), written: the runs of cells that each mode can enter, with the same label if eight-neighbour
    steps join them. Modes that can enter the same cells have the same labels, found once."""
    found: dict[frozenset, DataFrame] = {}
    out = None
    for mode, m in MODES.items():
        if m.get("flies"):
            continue
        classes = frozenset(costs(mode))
        if classes not in found:
            found[classes] = checkpoint(labelled_runs(cells, F.col("cls").isin(*classes), 1).select("cy", "xa", "xb", "label"))
        rows = found[classes].select(F.lit(mode).alias("mode"), "cy", "xa", "xb", "label")
        out = rows if out is None else out.union(rows)
    return out


def reachable(ends: DataFrame, labels: DataFrame) -> DataFrame:
    """(k, mode, reachable) for ends (k, mode, ax, ay, bx, by) of passable cells, null where nothing is in reach: whether the
    labels (mode, cy, xa, xb, label) of both are the same.

    Cells meet the runs of their row in stretches of columns, so that the lookup is an equi-join.
    """
    at = lambda c: F.floor(F.col(c) / STRETCH)
    runs = labels.withColumn("at", F.explode(F.sequence(at("xa"), at("xb"))))
    out = ends.select("k", "mode", "ax", "ay", "bx", "by")
    for end in "ab":
        r = runs.select("mode", F.col("cy").alias(f"{end}y"), F.col("at").alias("__at"), F.col("xa").alias("lo"), F.col("xb").alias("hi"), F.col("label").alias(f"{end}_label"))
        own = out.select("k", "mode", f"{end}x", f"{end}y", at(f"{end}x").alias("__at")).join(r, ["mode", f"{end}y", "__at"]).where(F.col(f"{end}x").between(F.col("lo"), F.col("hi")))
        out = out.join(own.select("k", "mode", f"{end}_label"), ["k", "mode"], "left")
    return out.select("k", "mode", F.coalesce(F.col("a_label") == F.col("b_label"), F.lit(False)).alias("reachable"))


def connections(journeys: DataFrame, cells: DataFrame, grid: Grid) -> DataFrame:
    """(k, mode, reachable) for journeys (k, mode, x1, y1, x2, y2): ends on the ground snap first, flights reach everything."""
    ground = reachable(ends_of(journeys, cells, grid), component_labels(cells))
    return ground.union(journeys.where(flies()).select("k", "mode", F.lit(True)))


def blocks_of(cells: DataFrame, size: int = 64) -> DataFrame:
    """(bx, by, xs, ys, classes): the cells of each block of size by size cells."""
    block = lambda c: F.floor(F.col(c) / size).cast("int")
    rows = cells.select(block("cx").alias("bx"), block("cy").alias("by"), "cx", "cy", "cls")
    return rows.groupBy("bx", "by").agg(F.sort_array(F.collect_list(F.struct("cy", "cx", "cls"))).alias("cells")).select(
        "bx", "by", F.transform("cells", lambda c: c["cx"]).alias("xs"), F.transform("cells", lambda c: c["cy"]).alias("ys"), F.transform("cells", lambda c: c["cls"]).alias("classes")
    )


STEPS = [(dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if dx or dy]
#: Origins that one task searches from at once, and the byte for places without a cell.
ORIGINS, NOWHERE = 8, 255
KEYS = ["mode", "origin", "bx", "by"]


def searched_as(mode: Column) -> Column:
    """The first mode whose costs are the same: horses find the ways that feet find."""
    out = mode
    for name, m in MODES.items():
        if not m.get("flies"):
            same = next(n for n, other in MODES.items() if not other.get("flies") and costs(n) == costs(name))
            out = F.when(mode == name, same).otherwise(out)
    return out


def block_and_place(x: str, y: str, size: int) -> tuple[Column, Column, Column]:
    """The block of a cell and its place in it, row by row, in a block with a margin of one cell."""
    bx, by = (F.floor(F.col(c) / size).cast("int") for c in (x, y))
    return bx, by, (F.col(y) - by * size + 1).cast("long") * (size + 2) + F.col(x) - bx * size + 1


def dense_blocks(cells: DataFrame, size: int) -> DataFrame:
    """(bx, by, classes): the classes of each block and of the cells round it, a byte each."""
    near = lambda c: F.explode(F.sequence(F.floor((F.col(c) - 1) / size).cast("int"), F.floor((F.col(c) + 1) / size).cast("int")))
    rows = cells.withColumn("bx", near("cx")).withColumn("by", near("cy"))
    place = (F.col("cy") - F.col("by") * size + 1) * (size + 2) + F.col("cx") - F.col("bx") * size + 1

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        out = np.full((size + 2) ** 2, NOWHERE, np.uint8)
        out[rows["place"].to_numpy()] = rows["cls"].to_numpy()
        return pd.DataFrame({"bx": rows["bx"][:1], "by": rows["by"][:1], "classes": [out.tobytes()]})

    return rows.select("bx", "by", place.cast("int").alias("place"), "cls").groupBy("bx", "by").applyInPandas(pack, "bx int, by int, classes binary")


def relax(weighted: np.ndarray, miles: np.ndarray, front: np.ndarray, enter: np.ndarray, side: int, most: np.ndarray) -> None:
    """Settles in place: steps from the places of front, then from whatever has become cheaper, until nothing does.

    enter has the cost of a mile into each place, infinite where none leads. A step costs its length in cells times
    that; of equal costs fewer miles win. Nothing is stepped from that costs more than most. All places that changed
    step at once, cheap ones first, so that few of them step again.
    """
    waiting = np.zeros(len(weighted), bool)
    waiting[front] = True
    while len(front):
        reach = weighted[front].min() + 8.0
        now = front[weighted[front] <= reach]
        waiting[now] = False
        changed = []
        now = now[weighted[now] <= most[now]]
        for dx, dy in STEPS:
            d = 2**0.5 if dx and dy else 1.0
            to = now + dy * side + dx
            w, m = weighted[now] + d * enter[to], miles[now] + d
            better = (w < weighted[to]) | ((w == weighted[to]) & (m < miles[to]) & (w < np.inf))
            to = to[better]
            weighted[to], miles[to] = w[better], m[better]
            changed.append(to)
        changed = np.concatenate(changed)
        waiting[changed] = True
        rest = np.concatenate((front, changed))
        front = np.unique(rest[waiting[rest]])


def settle(size: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Rows (mode, origin, bx, by, classes, weighted, miles, news, most, goals) of one block, for several origins, to its new
    states (what 0), what its goals cost (what 1), and offers to blocks round it for each cell that became cheaper (what 2).

    weighted and miles are doubles by place (null: nothing known), news offers of (places, weighted, miles).
    """
    side = size + 2
    inside = np.zeros((side, side), bool)
    inside[1:-1, 1:-1] = True
    inside = inside.ravel()
    edge = inside.reshape(side, side).copy()
    edge[2:-2, 2:-2] = False
    edge = np.flatnonzero(edge)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        mode, bx, by = rows["mode"].iat[0], int(rows["bx"].iat[0]), int(rows["by"].iat[0])
        price = np.full(256, np.inf)
        for code, cost in costs(mode).items():
            price[code] = cost
        price = price[np.frombuffer(rows["classes"].iat[0], np.uint8)]
        n, places = len(rows), side * side
        weighted, miles = np.full(n * places, np.inf), np.full(n * places, np.inf)
        front, most = [], np.repeat(rows["most"].to_numpy(), places)
        for k, r in enumerate(rows.itertuples(index=False)):
            if r.weighted is not None:
                weighted[k * places : (k + 1) * places] = np.frombuffer(r.weighted)
                miles[k * places : (k + 1) * places] = np.frombuffer(r.miles)
            for offer in r.news:
                at = np.frombuffer(offer["places"], np.int32) + k * places
                w, m = np.frombuffer(offer["weighted"]), np.frombuffer(offer["miles"])
                better = (w < weighted[at]) | ((w == weighted[at]) & (m < miles[at]))
                at = at[better]
                weighted[at], miles[at] = w[better], m[better]
                front.append(at)
        old = weighted.copy(), miles.copy()
        front = np.unique(np.concatenate(front))
        fresh = np.zeros(n * places, bool)
        fresh[front] = True
        relax(weighted, miles, front, np.tile(np.where(inside, price, np.inf), n), side, most)
        fresh |= (weighted != old[0]) | (miles != old[1])
        out = []
        for k, r in enumerate(rows.itertuples(index=False)):
            own = slice(k * places, (k + 1) * places)
            w, m = weighted[own], miles[own]
            if len(at := np.flatnonzero(fresh[own])):
                out.append((0, r.origin, bx, by, w.tobytes(), m.tobytes(), None, None, None, None))
            goals = [] if r.goals is None else [g for g in r.goals if w[g] < np.inf]
            out += [(1, r.origin, bx, by, None, None, None, int(g), float(w[g]), float(m[g])) for g in goals]
            leave = edge[fresh[own][edge] & (w[edge] <= r.most)]
            offers: dict[tuple, list] = {}
            for dx, dy in STEPS:
                d = 2**0.5 if dx and dy else 1.0
                to = leave + dy * side + dx
                met = ~inside[to] & (price[to] < np.inf)
                frm, to = leave[met], to[met]
                cost, length = w[frm] + d * price[to], m[frm] + d
                x, y = to % side - 1, to // side - 1  # from -1 to size
                ox, oy = (x >= size).astype(int) - (x < 0), (y >= size).astype(int) - (y < 0)
                place = (y - oy * size + 1) * side + x - ox * size + 1
                for q in set(zip(ox.tolist(), oy.tolist(), strict=True)):
                    own_way = (ox == q[0]) & (oy == q[1]) & (cost <= r.most)
                    offers.setdefault(q, []).append((place[own_way], cost[own_way], length[own_way]))
            for (ox, oy), parts in offers.items():
                place, cost, length = (np.concatenate(x) for x in zip(*parts, strict=True))
                order = np.lexsort((length, cost, place))
                place, cost, length = place[order], cost[order], length[order]
                first = np.concatenate(([True], place[1:] != place[:-1])) if len(place) else np.zeros(0, bool)
                if first.any():
                    out.append((2, r.origin, bx + ox, by + oy, cost[first].tobytes(), length[first].tobytes(), place[first].astype(np.int32).tobytes(), None, None, None))
        done = pd.DataFrame(out, columns=["what", "origin", "bx", "by", "weighted", "miles", "places", "goal", "goal_weighted", "goal_miles"])
        done["mode"] = mode
        return done

    return run


_SETTLED = "what int, origin long, bx int, by int, weighted binary, miles binary, places binary, goal long, goal_weighted double, goal_miles double, mode string"


def offered(starts: DataFrame, size: int) -> DataFrame:
    """starts (mode, origin, cx, cy) as offers without cost."""

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            pdf["places"] = [np.array([p], np.int32).tobytes() for p in pdf["place"]]
            pdf["weighted"] = pdf["miles"] = [np.zeros(1).tobytes()] * len(pdf)
            yield pdf[[*KEYS, "places", "weighted", "miles"]]

    bx, by, place = block_and_place("cx", "cy", size)
    rows = starts.select("mode", F.col("origin").cast("long").alias("origin"), bx.alias("bx"), by.alias("by"), place.alias("place"))
    return rows.mapInPandas(pack, "mode string, origin long, bx int, by int, places binary, weighted binary, miles binary")


def explore(starts: DataFrame, cells: DataFrame, size: int, goals: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """What starts (mode, origin, cx, cy) lead to: (mode, origin, bx, by, weighted, miles), the state of each block by
    place, and (mode, origin, cx, cy, weighted, miles) of goals (mode, origin, cx, cy).

    A superstep settles the blocks that have offers, each for several origins, and writes what it has settled and
    offers; states of blocks without offers stay where they were written. With goals, what costs more than all the
    goals of its origin are known to cost at most is not followed, so a search ends soon after it has met its last goal; values
    further out may then be too high, but none on a way to a goal.
    """
    blocks = checkpoint(dense_blocks(cells, size))
    chunks = max(1, -(-starts.select("origin").distinct().count() // ORIGINS))
    if goals is None:
        targets = None
    else:
        bx, by, place = block_and_place("cx", "cy", size)
        targets = checkpoint(goals.select("mode", F.col("origin").cast("long").alias("origin"), "cx", "cy", bx.alias("bx"), by.alias("by"), place.alias("goal")).distinct())
    offers, states, reached, step = checkpoint(offered(starts, size)), None, None, 0
    while True:
        news = offers.groupBy(*KEYS).agg(F.collect_list(F.struct("places", "weighted", "miles")).alias("news"))  # of eight blocks at most
        active = news.join(blocks, ["bx", "by"])
        if states is None:
            active = active.withColumns({c: F.lit(None).cast("binary") for c in ("weighted", "miles")})
        else:
            last = states.select(*KEYS, "step").join(news.select(*KEYS), KEYS, "left_semi").groupBy(*KEYS).agg(F.max("step").alias("step"))
            active = active.join(states.join(last, [*KEYS, "step"]).drop("step"), KEYS, "left")
        most, here = F.lit(np.inf).alias("most"), F.lit(None).cast("array<long>").alias("goals")
        if targets is not None:
            own = targets.groupBy(*KEYS).agg(F.collect_list("goal").alias("goals"))
            known = targets if reached is None else targets.join(reached, [*KEYS, "goal"], "left")
            cost = F.lit(np.inf) if reached is None else F.coalesce("goal_weighted", F.lit(np.inf))
            bounds = known.groupBy("mode", "origin").agg(F.max(cost).alias("most"))
            active = active.join(own, KEYS, "left").join(bounds, ["mode", "origin"])
            most, here = F.col("most"), F.col("goals")
        active = active.select(*KEYS, "classes", "weighted", "miles", "news", most, here, F.pmod(F.xxhash64("origin"), F.lit(chunks)).alias("chunk"))
        done = checkpoint(active.groupBy("mode", "bx", "by", "chunk").applyInPandas(settle(size), _SETTLED))
        settled = done.where("what = 0").select(*KEYS, "weighted", "miles", F.lit(step).alias("step"))
        states, step = settled if states is None else states.union(settled), step + 1
        if targets is not None:
            met = done.where("what = 1").select(*KEYS, "goal", "goal_weighted", "goal_miles")
            met = met if reached is None else met.union(reached)
            best = F.min(F.struct("goal_weighted", "goal_miles")).alias("b")
            reached = checkpoint(met.groupBy(*KEYS, "goal").agg(best).select(*KEYS, "goal", "b.*"))
        offers = done.where("what = 2").select(*KEYS, "places", "weighted", "miles")
        if offers.isEmpty():
            break
    final = states.groupBy(*KEYS).agg(F.max("step").alias("step")).join(states, [*KEYS, "step"]).drop("step")
    if targets is None:
        return final, None
    return final, targets.join(reached, [*KEYS, "goal"]).select("mode", "origin", "cx", "cy", F.col("goal_weighted").alias("weighted"), F.col("goal_miles").alias("miles"))


def unpacked(state: DataFrame, size: int) -> DataFrame:
    """(mode, origin, cx, cy, weighted, miles) of the cells of states that have been reached."""
    side = size + 2

    def cells_of(rows: pd.DataFrame) -> pd.DataFrame:
        r = rows.iloc[0]
        w, m = np.frombuffer(r["weighted"]), np.frombuffer(r["miles"])
        at = np.flatnonzero(w < np.inf)
        x, y = r["bx"] * size + at % side - 1, r["by"] * size + at // side - 1
        return pd.DataFrame({"mode": r["mode"], "origin": r["origin"], "cx": x, "cy": y, "weighted": w[at], "miles": m[at]})

    return state.groupBy(*KEYS).applyInPandas(cells_of, "mode string, origin long, cx int, cy int, weighted double, miles double")


def search(starts: DataFrame, cells: DataFrame, size: int = BLOCK) -> DataFrame:
    """(mode, origin, cx, cy, weighted, miles), in cells, for every cell that starts (mode, origin, cx, cy) lead to."""
    return unpacked(explore(starts, cells, size)[0], size)


def flies() -> Column:
    return F.col("mode").isin(*(n for n, m in MODES.items() if m.get("flies")))


def ends_of(journeys: DataFrame, cells: DataFrame, grid: Grid) -> DataFrame:
    """(k, mode, ax, ay, bx, by, origin), written: the passable cells nearest to the ends of journeys on the ground; null if there is none."""
    from ..functions.geo import cell_of

    ground = journeys.where(~flies())
    cell = lambda x, y: (cell_of(F.col(x), grid.min_lon, grid.cell, grid.width).alias("cx"), cell_of(F.col(y), grid.min_lat, grid.cell, grid.height).alias("cy"))
    a = snap_cell(ground.select("k", "mode", *cell("x1", "y1")), cells).select("k", "mode", F.col("sx").alias("ax"), F.col("sy").alias("ay"))
    b = snap_cell(ground.select("k", "mode", *cell("x2", "y2")), cells).select("k", "mode", F.col("sx").alias("bx"), F.col("sy").alias("by"))
    return checkpoint(a.join(b, ["k", "mode"]).withColumn("origin", F.col("ay").cast("long") * (1 << 31) + F.col("ax")))


def starts_and_goals(ends: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(mode, origin, cx, cy) of the starts and of the goals of ends that have both, with the modes they are searched as."""
    both = ends.where("ax IS NOT NULL AND bx IS NOT NULL").withColumn("mode", searched_as(F.col("mode")))
    starts, goals = (both.select("mode", "origin", F.col(f"{c}x").alias("cx"), F.col(f"{c}y").alias("cy")).distinct() for c in "ab")
    return starts, goals


def for_modes(found: DataFrame, ends: DataFrame) -> DataFrame:
    """found, of the modes searched, for every mode and origin of ends."""
    own = ends.select("mode", "origin").distinct().withColumn("as", searched_as(F.col("mode")))
    return found.withColumnRenamed("mode", "as").join(own, ["as", "origin"]).select("mode", "origin", "cx", "cy", "weighted", "miles")


def search_from(ends: DataFrame, cells: DataFrame, size: int = BLOCK) -> DataFrame:
    """(mode, origin, cx, cy, weighted, miles) of the cells from the starts of ends out to their goals."""
    starts, goals = starts_and_goals(ends)
    return for_modes(unpacked(explore(starts, cells, size, goals)[0], size), ends)


def goal_costs(ends: DataFrame, cells: DataFrame, size: int = BLOCK) -> DataFrame:
    """search_from() for the goals alone."""
    starts, goals = starts_and_goals(ends)
    return for_modes(explore(starts, cells, size, goals)[1], ends)


def measured(journeys: DataFrame, ends: DataFrame, found: DataFrame, grid: Grid, miles_per_degree: float) -> DataFrame:
    """journeys (k, mode, x1, y1, x2, y2) with miles, weighted_miles, days and error, from their ends and the cells found."""
    speed = F.lit(None).cast("double")
    for name, m in MODES.items():
        speed = F.when(F.col("mode") == name, m["miles_per_day"]).otherwise(speed)
    goals = found.select("mode", "origin", F.col("cx").alias("bx"), F.col("cy").alias("by"), "weighted", "miles")
    routed = ends.join(goals, ["mode", "origin", "bx", "by"], "left")
    miles_per_cell = grid.cell * miles_per_degree
    error = F.when(F.col("ax").isNull(), "unreachable-origin").when(F.col("bx").isNull(), "unreachable-destination").when(F.col("weighted").isNull(), "no-route")
    routed = routed.select("k", "mode", (F.col("miles") * miles_per_cell).alias("miles"), (F.col("weighted") * miles_per_cell).alias("weighted_miles"), error.alias("error"))
    routed = routed.withColumn("days", F.col("weighted_miles") / speed)
    straight = F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")) * miles_per_degree
    flown = journeys.where(flies()).select("k", "mode", straight.alias("miles"), straight.alias("weighted_miles"), F.lit(None).cast("string").alias("error"), (straight / speed).alias("days"))
    return routed.unionByName(flown)


def shortest_days(journeys: DataFrame, cells: DataFrame, grid: Grid, miles_per_degree: float, size: int = BLOCK) -> DataFrame:
    """journeys (k, mode, x1, y1, x2, y2) with miles, weighted_miles, days and error.

    Flights are straight. Else both ends snap to passable cells, and one search an origin serves all its journeys;
    error is unreachable-origin, unreachable-destination or no-route.
    """
    ends = ends_of(journeys, cells, grid)
    return measured(journeys, ends, goal_costs(ends, cells, size), grid, miles_per_degree)


def od_pairs(journeys: DataFrame, places: DataFrame) -> DataFrame:
    """journeys (k, origin, destination) with x1, y1, x2, y2 of the places of these names, and error if a name is unknown.

    Of places that share a name the last in order counts; an unknown origin is told before an unknown destination.
    """
    at = places.groupBy("name").agg(F.max_by(F.struct("lon", "lat"), "place_idx").alias("at"))
    a, b = (at.select(F.col("name").alias(name), F.col("at").alias(alias)) for name, alias in (("origin", "a"), ("destination", "b")))
    met = journeys.join(a, "origin", "left").join(b, "destination", "left")
    error = F.when(F.col("a").isNull(), "unknown-origin").when(F.col("b").isNull(), "unknown-destination")
    return met.select("k", "origin", "destination", F.col("a.lon").alias("x1"), F.col("a.lat").alias("y1"), F.col("b.lon").alias("x2"), F.col("b.lat").alias("y2"), error.alias("error"))


def check_connectivity(expected: DataFrame, found: DataFrame) -> DataFrame:
    """expected (k, mode, expected) with verdict, by found (k, mode, reachable); a journey that was not found is unreachable."""
    is_ = F.coalesce("reachable", F.lit(False))
    verdict = F.when(is_ == F.col("expected"), "as expected").when(is_, "reachable but should not be").otherwise("unreachable")
    return expected.join(found, ["k", "mode"], "left").select("k", "mode", "expected", is_.alias("reachable"), verdict.alias("verdict"))


def route_fixtures(routes: DataFrame) -> DataFrame:
    """Reference results of routes (origin, destination, mode, miles, days, error, path): what later versions are held to."""
    blocked = F.col("error").isNotNull()
    points = F.when(~blocked, F.size("path"))
    return routes.select("origin", "destination", "mode", "miles", "days", points.alias("pathPoints"), flies().alias("straightLine"), blocked.alias("blocked"))


def compare_modes(pairs: DataFrame) -> DataFrame:
    """Every pair with every mode."""
    return pairs.withColumn("mode", F.explode(F.array(*map(F.lit, MODES))))


def check_routes(routes: DataFrame, bounds: DataFrame) -> DataFrame:
    """bounds (k, mode, low, high) with verdict: ok, out of range, or the route's error."""
    met = bounds.join(routes, ["k", "mode"], "left")
    verdict = F.when(F.col("error").isNotNull(), F.col("error")).when(F.col("days").between(F.col("low"), F.col("high")), "ok").otherwise("out of range")
    return met.select("k", "mode", verdict.alias("verdict"))


def compare_fixtures(found: DataFrame, wanted: DataFrame, tolerance: float = 0.001) -> DataFrame:
    """(k, mode, same): whether miles and days agree within tolerance, or both sides have no route."""
    met = wanted.alias("w").join(found.alias("f"), ["k", "mode"], "full")
    near = lambda c: F.abs(F.col(f"f.{c}") - F.col(f"w.{c}")) <= tolerance * F.abs(F.col(f"w.{c}"))
    blocked = F.col("w.days").isNull() & F.col("f.days").isNull()
    return met.select("k", "mode", F.coalesce(blocked | (near("miles") & near("days")), F.lit(False)).alias("same"))
