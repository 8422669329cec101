"""Mixing sources to target weights by entropy balancing.

Of all document rates between 0 and ``most`` copies whose words meet every source's target, the ones closest in
relative entropy to one copy each are ``min(most, exp(lambda_source * size / mean size))``: exponentially tilted by size.
The multipliers solve a convex dual, one dimension a source, by Newton steps kept inside a bracket. A rate depends on
source and size alone, so the texts are read once into a table of (source, size, documents) and each Newton iteration is
one aggregation of that table; sums are exact decimals, so reruns agree to the last copy. Rates are then rounded to whole
copies: cumulatively from long to short documents of a source, then by moving a copy in the cell whose size is nearest
to what the source still lacks or exceeds, ``REPAIRS`` times. Copies of a cell are dealt evenly by the rank of the
documents' hashes, ranked within sub-cells of about ``SUBCELL`` documents, so a cell that holds a third of all rows is
spread over tasks.

Targets: sources in code point order, null last, weigh 1, 2, 3, 1, ...; they share the budget (all words) by weight, no
target above ``most`` times its source's words, the excess shared anew by weight until none is above: a water level,
found by sorting the sources by words per weight. That sort is the one step that sees all sources at once: one row each.

Cases: a null text has size 0; a null source is a source of its own; documents of size 0 keep one copy and take no words;
repeated rows are separate documents; ties in the hash are rows that are alike but for unread columns; an empty table
gives an empty mix; unread columns are carried by ``mix_documents`` under their own names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.runtime import WORD, materialise, text_or_empty

WEIGHTS = (1, 2, 3)
SUBCELL = 256
REPAIRS = 4
_EXACT = "decimal(38,9)"


def sizes(docs: DataFrame, id_col: str, source_col: str, text_col: str, carry: tuple[str, ...] = ()) -> DataFrame:
    text = text_or_empty(text_col)
    return docs.select(
        F.col(f"`{id_col}`").alias("id"),
        F.col(f"`{source_col}`").cast("string").alias("source"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        F.xxhash64(F.col(f"`{id_col}`"), text).alias("hash"),
        *[F.col(f"`{c}`").alias(f"carry{i}") for i, c in enumerate(carry)],
    )


def source_targets(cells: DataFrame, most: int = 3, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Rows (source, source_size, target)."""
    per = cells.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight.cast("double")).withColumn("cap", (most * F.col("source_size")).cast("double"))
    # Sources whose cap is reached first come first; the level is what is left for the others, by weight.
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, rest = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy())
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    per = per.withColumn("level", level).withColumn("open", F.col("level") * F.col("weight") < F.col("cap"))
    water = F.min(F.when(F.col("open"), F.struct(F.col("cap") / F.col("weight"), F.col("level")))).over(Window.partitionBy())
    per = per.withColumn("water", water["level"])
    return per.select("source", "source_size", F.least(F.col("cap"), F.coalesce(F.col("water") * F.col("weight"), F.col("cap"))).alias("target"))


def _rate(most: int) -> Column:
    """Copies that a document of this size is due, before rounding."""
    tilted = F.least(F.lit(float(most)), F.exp(F.least(F.lit(50.0), F.col("lam") * F.col("size") / F.col("mean"))))
    return F.when(F.col("size") == 0, F.lit(1.0)).when(F.col("full"), F.lit(float(most))).otherwise(tilted)


def solve(cells: DataFrame, targets: DataFrame, most: int = 3, tolerance: float = 1e-7, iterations: int = 60) -> DataFrame:
    """Rows (source, source_size, target, mean, full, lam): the dual's multipliers by Newton iterations over the cells."""
    per = cells.where("size > 0").groupBy("source").agg(F.sum("n").alias("docs"), F.min("size").alias("least"))
    state = targets.join(per, targets["source"].eqNullSafe(per["source"]), "left").select(
        targets["source"], "source_size", "target",
        F.coalesce(F.col("source_size") / F.col("docs"), F.lit(1.0)).alias("mean"),
        (F.col("target") >= most * F.col("source_size") * (1 - 1e-12)).alias("full"),
        F.lit(0.0).alias("lam"), F.lit(-1e4).alias("lo"),
        (F.lit(1.2) * F.log(F.lit(float(most))) * F.col("source_size") / F.col("docs") / F.col("least") + 1).alias("hi"),
    )
    state = materialise(state, "mix-state")
    for _ in range(iterations):
        held = cells.alias("c").join(state.alias("s"), F.col("c.source").eqNullSafe(F.col("s.source"))).select("s.source", "size", "n", "lam", "mean", "full")
        r = _rate(most)
        words = F.col("n") * F.col("size") * r
        slope = F.when((r < most) & (F.col("size") > 0), words * F.col("size") / F.col("mean")).otherwise(0.0)
        sums = held.groupBy("source").agg(F.sum(words.cast(_EXACT)).cast("double").alias("words"), F.sum(slope.cast(_EXACT)).cast("double").alias("slope"))
        s, m = state.alias("s"), sums.alias("m")
        off = F.col("words") - F.col("target")
        lo, hi = F.when(off < 0, F.col("lam")).otherwise(F.col("lo")), F.when(off > 0, F.col("lam")).otherwise(F.col("hi"))
        step = F.col("lam") - off / F.when(F.col("slope") > 0, F.col("slope"))
        done = F.col("full") | (F.col("source_size") == 0) | (F.abs(off) <= tolerance * F.col("target"))
        moved = s.join(m, F.col("s.source").eqNullSafe(F.col("m.source"))).select("s.source", "source_size", "target", "mean", "full", "lam", lo.alias("lo"), hi.alias("hi"), step.alias("step"), done.alias("done"))
        inside = (F.col("step") > F.col("lo")) & (F.col("step") < F.col("hi"))
        near = F.when(F.col("lo") <= -1e4, F.least(F.col("lam") * 2, F.lit(-1.0)) - 1).otherwise((F.col("lo") + F.col("hi")) / 2)
        lam = F.when(F.col("done"), F.col("lam")).when(F.coalesce(inside, F.lit(False)), F.col("step")).when(off_sign(), near).otherwise((F.col("lo") + F.col("hi")) / 2)
        state = materialise(moved.withColumn("lam", lam).drop("step"), "mix-state")
        if not state.where("NOT done").limit(1).count():
            break
    return state.select("source", "source_size", "target", "mean", "full", "lam")


def off_sign() -> Column:
    """Whether the bracket still lacks a lower end."""
    return F.col("lo") <= -1e4


def round_cells(cells: DataFrame, solved: DataFrame, most: int = 3) -> DataFrame:
    """Rows (source, size, n, copies, source_size, target): whole copies of every cell."""
    c, s = cells.alias("c"), solved.alias("s")
    due = c.join(s, F.col("c.source").eqNullSafe(F.col("s.source"))).select("c.source", "size", "n", "source_size", "target", (F.col("n") * _rate(most)).cast(_EXACT).alias("due"))
    down = Window.partitionBy("source").orderBy(F.col("size").desc())
    upto = F.floor(F.sum("due").over(down.rowsBetween(Window.unboundedPreceding, 0)) + F.lit(0.5).cast(_EXACT)).cast("long")
    before = F.lag("upto", 1, 0).over(down)
    out = due.withColumn("upto", upto).withColumn("copies", F.greatest(F.lit(0).cast("long"), F.least(most * F.col("n"), F.col("upto") - before))).drop("upto", "due")
    out = materialise(out, "mix-cells")
    for _ in range(REPAIRS):
        lack = out.groupBy("source").agg((F.max("target") - F.sum(F.col("copies") * F.col("size"))).alias("lack"))
        o, k = out.alias("o"), lack.alias("k")
        room = o.join(k, F.col("o.source").eqNullSafe(F.col("k.source"))).select("o.*", "lack")
        can = (F.col("size") > 0) & F.when(F.col("lack") > 0, F.col("copies") < most * F.col("n")).otherwise(F.col("copies") > 0)
        better = F.abs(F.abs(F.col("lack")) - F.col("size")) < F.abs(F.col("lack"))
        pick = room.where(can & better).groupBy("source").agg(F.min(F.struct(F.abs(F.abs(F.col("lack")) - F.col("size")).alias("miss"), F.col("size").alias("at"), F.signum("lack").cast("long").alias("by"))).alias("p"))
        p = pick.select("source", "p.at", "p.by").alias("p")
        out = o.join(p, F.col("o.source").eqNullSafe(F.col("p.source")) & (F.col("size") == F.col("at")), "left").select("o.source", "size", "n", "source_size", "target", (F.col("copies") + F.coalesce(F.col("by"), F.lit(0))).alias("copies"))
        out = materialise(out, "mix-cells")
    return out


def plan_mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", most: int = 3, weights: tuple[int, ...] = WEIGHTS, carry: tuple[str, ...] = ()) -> DataFrame:
    """Rows (id, source, size, source_size, target, copies, carry0, ...) of every document."""
    thin = sizes(docs, id_col, source_col, text_col, carry)
    if not carry:
        thin = materialise(thin, "mix-sizes")
    cells = materialise(thin.groupBy("source", "size").agg(F.count("*").alias("n")), "mix-hist")
    rounded = round_cells(cells, solve(cells, source_targets(cells, most, weights), most), most)
    d, c = thin.alias("d"), rounded.withColumn("subs", F.ceil(F.col("n") / SUBCELL).cast("long")).alias("c")
    held = d.join(c, F.col("d.source").eqNullSafe(F.col("c.source")) & (F.col("d.size") == F.col("c.size"))).select("d.*", "n", "copies", "source_size", "target", F.pmod(F.xxhash64("hash"), F.col("subs")).alias("sub"))
    if carry:  # ranks need two looks at the rows: their texts stay in one table
        held = materialise(held, "mix-held")
    counts = held.groupBy("source", "size", "sub").agg(F.count("*").alias("m"))
    over = Window.partitionBy("source", "size").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("first", F.coalesce(F.sum("m").over(over), F.lit(0))).alias("f")
    within = held.withColumn("rank", F.row_number().over(Window.partitionBy("source", "size", "sub").orderBy("hash"))).alias("h")
    placed = within.join(starts, F.col("h.source").eqNullSafe(F.col("f.source")) & (F.col("h.size") == F.col("f.size")) & (F.col("h.sub") == F.col("f.sub"))).select("h.*", (F.col("first") + F.col("rank")).alias("place"))
    share = lambda k: F.expr(f"({k}) * copies div n")
    return placed.select("id", "source", "size", "source_size", "target", (share("place") - share("place - 1")).alias("copies"), *[f"carry{i}" for i in range(len(carry))])


def mix_report(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", most: int = 3) -> DataFrame:
    """Rows (id, size, source_size, target, taken, copies)."""
    return plan_mix(docs, id_col, source_col, text_col, most).select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def mix_documents(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", most: int = 3) -> DataFrame:
    """The documents with all their columns, each as often as the mix takes it."""
    cols = docs.columns
    planned = plan_mix(docs, id_col, source_col, text_col, most, carry=tuple(cols))
    repeated = planned.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return repeated.select(*[F.col(f"carry{i}").alias(c) for i, c in enumerate(cols)])
