r"""Secret scan with multipart credential linking.

Strong parts are reported wherever they stand: assignments of secrets, access ids and long hex strings (the base). Weak
parts are reported only where a complementary part stands in the same scope, that is, at most ``SCOPE`` code points lie
between the end of one and the start of the other, however long they are: a mixed string that might be a secret needs an identifier or an endpoint, an identifier (user, client id, ...)
needs a secret, an endpoint needs both. The link is an interval join of the parts of a document with themselves, run as
running windows over parts sorted by position, forwards and backwards: no pair of parts is ever made.

Offsets come from the split of a text at a pattern: the lengths of what lies between matches and of the matches add up
to code point positions. Only parts leave the scan of the texts; a text without parts sends one thin row.

Cases: a null text counts as empty and has no spans; repeated rows and ids are scanned each for itself (a row id made in
the scan keeps them apart); texts are scanned whole; parts with equal starts come in the order of ``KINDS``; an empty
table gives an empty result; other columns are not read, or carried by ``redact`` under their own names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.runtime import SPACE, materialise, text_or_empty

SCOPE = 200
#: Order of kinds at equal starts; the first three are the base.
KINDS = ("assign", "access", "hex", "secret", "identifier", "endpoint")


def _either(word: str) -> str:
    """A pattern for ASCII letters of either case."""
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_VALUE, _GIVEN = "[A-Za-z0-9+/_.=-]+", r"""["']?\x20*[:=]\x20*["']?"""
_SECRET_NAMES = "|".join(map(_either, ("password", "passwd", "secret", "token", "api_?key")))
_IDENTIFIER_NAMES = "|".join(map(_either, ("user_?name", "user", "login", "account", "client_?id", "access_?key_?id")))
_RUN = "A-Za-z0-9+/_=-"
PATTERNS = {
    "assign": f"({_SECRET_NAMES}){_GIVEN}({_VALUE})",
    "access": "AKIA[A-Z0-9]{12,}",
    "hex": "(?<![0-9a-f])[0-9a-f]{32,}",
    "secret": f"(?<![{_RUN}])(?=[{_RUN}]{{20}})(?=[a-z0-9+/_=-]*[A-Z])(?=[A-Z0-9+/_=-]*[a-z])(?=[A-Za-z+/_=-]*[0-9])[{_RUN}]+",
    "identifier": f"(?<![A-Za-z0-9])({_IDENTIFIER_NAMES}){_GIVEN}([A-Za-z0-9@._+-]{{3,}})",
    "endpoint": rf"(?<![A-Za-z0-9])[a-z][a-z0-9+.-]{{1,15}}://[^{SPACE}\"'<>]+",
}
#: What a text must match to have any part of the kind; cheaper than, and implied by, the pattern.
TRIGGERS = PATTERNS | {"access": "AKIA[A-Z0-9]{12}", "hex": "[0-9a-f]{32}"}
#: Shortest value of an assignment. A shorter one is no part, but takes its characters from what may follow, so the pattern
#: finds it all the same; every other pattern finds parts alone, as its least length only leaves out runs that hold no part.
LEAST_VALUE = 8


def _parts(text: str, kind: str) -> Column:
    """Array of (kind, order, i, gap, size, held) of a kind's matches: the code points before the match, in it and in its value."""
    pattern = F.lit(PATTERNS[kind])
    sizes = lambda group: F.transform(F.regexp_extract_all(text, pattern, F.lit(group)), lambda x: F.length(x))
    gaps = F.transform(F.split(F.col(text), PATTERNS[kind], -1), lambda x: F.length(x))
    found = F.arrays_zip(gaps.alias("gap"), sizes(0).alias("size"), sizes(2 if kind == "assign" else 0).alias("held"))
    matches = F.slice(found, 1, F.size(found) - 1)  # what follows the last match has none
    rows = F.transform(matches, lambda x, i: F.struct(F.lit(kind).alias("kind"), F.lit(KINDS.index(kind)).alias("order"), i.alias("i"), x["gap"].alias("gap"), x["size"].alias("size"), x["held"].alias("held")))
    return F.when(F.col(text).rlike(TRIGGERS[kind]), rows)


def parts_of(rows: DataFrame) -> DataFrame:
    """(rid, id, kind, order, start, end) of every part, from (rid, id, text); a text without parts has one row of nulls."""
    empty = F.array().cast("array<struct<kind:string,order:int,i:int,gap:int,size:int,held:int>>")
    every = F.concat(*[F.coalesce(_parts("text", k), empty) for k in KINDS])
    flat = rows.select("rid", "id", F.explode_outer(every).alias("p")).select("rid", "id", "p.*").repartition("rid")
    kind = Window.partitionBy("rid", "order").orderBy("i")
    placed = flat.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(kind)).withColumn("start", F.col("end") - F.col("size"))
    # Short values have done their part in the sums; of a text that has nothing else, the first stays as its row of nulls.
    good = (F.col("kind") != "assign") | (F.col("held") >= LEAST_VALUE)
    first = F.row_number().over(Window.partitionBy("rid").orderBy("order", "i")) == 1
    placed = placed.withColumns({"good": F.coalesce(good, F.lit(False)), "first": first}).where("good OR first")
    return placed.select("rid", "id", *[F.when(F.col("good"), F.col(c)).alias(c) for c in ("kind", "order", "start", "end")])


def link(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The parts with ``reported`` and, for each, the nearest identifier, secret and endpoint of its scope before and after.

    All frames grow from an end of the document, so every window is one running pass over its parts.
    """
    up = Window.partitionBy("rid").orderBy("start", "order")
    down = Window.partitionBy("rid").orderBy(F.col("start").desc(), F.col("order").desc())
    before_all, after_all = up.rowsBetween(Window.unboundedPreceding, -1), down.rowsBetween(Window.unboundedPreceding, -1)
    base = F.col("order") < 3
    reach = F.max(F.when(base, F.col("end"))).over(before_all)
    ahead = F.min(F.when(base, F.col("start"))).over(after_all)
    inside = ~base & ((F.coalesce(reach, F.lit(-1)) > F.col("start")) | (F.coalesce(ahead, F.col("end")) < F.col("end")))
    # A weak part over a strong one is that part again.
    left = parts.withColumn("again", inside).where(F.col("start").isNull() | ~F.coalesce(F.col("again"), F.lit(False)))
    role = F.when(F.col("kind").isin("access", "identifier"), "identifier").when(F.col("kind") == "endpoint", "endpoint").when(F.col("kind").isNotNull(), "secret")
    out = left.withColumn("role", role)
    # Of the parts up to this one, the end that reaches farthest; of those from this one on, the first start.
    back, on = up.rowsBetween(Window.unboundedPreceding, 0), down.rowsBetween(Window.unboundedPreceding, 0)
    roles = ("identifier", "secret", "endpoint")
    out = out.select("*", *[F.max(F.when(F.col("role") == r, F.struct("end", "start"))).over(back).alias(f"{r}_before") for r in roles])
    out = out.select("*", *[F.min(F.when(F.col("role") == r, F.struct("start", "end"))).over(on).alias(f"{r}_after") for r in roles])
    for r in roles:
        before, after = F.col(f"{r}_before"), F.col(f"{r}_after")
        out = out.withColumn(f"{r}_before", F.when(F.col("start") - before["end"] <= scope, F.struct(before["start"].alias("start"), before["end"].alias("end"))))
        out = out.withColumn(f"{r}_after", F.when(after["start"] - F.col("end") <= scope, after))
    has = lambda r: F.col(f"{r}_before").isNotNull() | F.col(f"{r}_after").isNotNull()
    weak = F.when(F.col("kind") == "secret", has("identifier") | has("endpoint")).when(F.col("kind") == "identifier", has("secret")).when(F.col("kind") == "endpoint", has("identifier") & has("secret"))
    return out.withColumn("reported", F.coalesce(base | weak, F.lit(False)))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.monotonically_increasing_id().alias("rid"), F.col(f"`{id_col}`").alias("id"), text_or_empty(text_col).alias("text"))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """Rows (id, n_assign, n_access, n_hex, n_linked, base_spans, spans), a row a document; spans are (kind, start, end)."""
    linked = link(parts_of(_rows(docs, id_col, text_col)), scope)
    entry = F.struct("start", "order", "kind", "end")
    count = lambda k: F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{k}")
    row = linked.groupBy("rid").agg(
        F.first("id").alias(id_col), count("assign"), count("access"), count("hex"),
        F.count(F.when(F.col("reported") & (F.col("order") >= 3), 1)).alias("n_linked"),
        F.sort_array(F.collect_list(F.when(F.col("reported"), entry))).alias("all"),
    )
    shown = lambda c: F.transform(c, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    return row.select(id_col, "n_assign", "n_access", "n_hex", "n_linked", shown(F.filter("all", lambda x: x["order"] < 3)).alias("base_spans"), shown(F.col("all")).alias("spans"))


def written(spans: str) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


_CHUNK = 512


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE, mark: str = "[SECRET]") -> DataFrame:
    """The documents with all their columns; every reported span of a text, overlapping ones together, becomes ``mark``.

    Texts that match no trigger go through untouched and unmoved; the others are written once with a row id, so that
    their spans can come back to them.
    """
    cols = docs.columns
    hit = F.lit(False)
    for k in KINDS:
        hit = hit | text_or_empty(text_col).rlike(TRIGGERS[k])
    touched = materialise(docs.where(hit).select(F.monotonically_increasing_id().alias("rid"), *[F.col(f"`{c}`").alias(f"carry{i}") for i, c in enumerate(cols)]), "secrets")
    t, key = f"carry{cols.index(text_col)}", f"carry{cols.index(id_col)}"
    found = link(parts_of(touched.select("rid", F.col(key).alias("id"), F.col(t).alias("text"))), scope).where("reported")
    order = Window.partitionBy("rid").orderBy("start", "order")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = found.withColumn("new", F.when(F.coalesce(reach, F.lit(-1)) < F.col("start"), 1).otherwise(0)).withColumn("run", F.sum("new").over(order))
    merged = runs.groupBy("rid", "run").agg(F.min("start").alias("a"), F.max("end").alias("b"))
    spans = merged.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("spans"))
    back = touched.join(spans, "rid", "left").withColumn("chunks", F.when(F.col("spans").isNotNull(), F.regexp_extract_all(t, F.lit(f"(?s).{{1,{_CHUNK}}}"), F.lit(0))))

    def cut(a: Column, b: Column) -> Column:
        """Code points a to b of the chunked text."""
        first = F.floor(a / _CHUNK).cast("int")
        chunks = F.slice("chunks", first + 1, F.floor((b + _CHUNK - 1) / _CHUNK).cast("int") - first)
        return F.when(a >= b, "").otherwise(F.substring(F.array_join(chunks, ""), (a - first * _CHUNK + 1).cast("int"), (b - a).cast("int")))

    kept = F.transform("spans", lambda x, i: F.concat(cut(F.when(i == 0, F.lit(0)).otherwise(F.get("spans", F.greatest(i - 1, F.lit(0)))["b"]), x["a"]), F.lit(mark)))
    tail = cut(F.element_at("spans", -1)["b"], F.length(t))
    new = F.when(F.col("spans").isNull(), F.col(t)).otherwise(F.concat(F.array_join(kept, ""), tail))
    done = back.withColumn("new", new).select(*[(F.col("new") if c == text_col else F.col(f"carry{i}")).alias(c) for i, c in enumerate(cols)])
    return docs.where(~hit).unionByName(done)
