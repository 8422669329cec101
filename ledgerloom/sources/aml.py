"""Readers of the transfer ledger's files: transactions, accounts and the text file of labelled rings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import SHAPES, micros, normalize_bank, null_text

#: The columns of a transactions file by position; its header names one of them twice.
COLUMNS = ("ts", "from_bank", "from_account", "to_bank", "to_account", "amount_received", "receiving_currency", "amount_paid", "payment_currency", "payment_format", "is_laundering")
FORMAT = "yyyy/MM/dd HH:mm"
MONEY = "decimal(20,2)"


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """(line, no): the lines of text files with their numbers from 1, in file order.

    Numbers are places within a partition plus the sizes of the partitions before it, as many as there are input splits.
    """
    rows = spark.read.text(path).select(F.col("value").alias("line"), F.monotonically_increasing_id().alias("mid"))
    part, at = F.shiftright("mid", 33), F.col("mid").bitwiseAND((1 << 33) - 1)
    rows = rows.select("line", part.alias("part"), at.alias("at"))
    sizes = rows.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return rows.join(F.broadcast(before), "part").select("line", (F.col("before") + F.col("at") + 1).alias("no"))


def _fields(line: Column) -> Column:
    """The fields of a line, trimmed. A field in double quotes may hold commas, and quotes written twice; not line breaks."""
    quoted = F.transform(F.split(line, ',(?=(?:[^"]*"[^"]*")*[^"]*$)', -1), lambda x: F.replace(F.regexp_replace(F.trim(x), '^"(.*)"$', "$1"), F.lit('""'), F.lit('"')))
    return F.transform(F.when(line.contains('"'), quoted).otherwise(F.split(line, ",", -1)), lambda x: F.trim(x))


def _transfer(is_transfer: Column) -> Column:
    """A struct of the columns of a transfer's line; a wrong number of columns is an error. Other lines give nulls, as filters
    may be moved past this."""
    line = F.when(is_transfer, F.col("line"))
    parts = _fields(line)
    right = F.when(F.size(parts) == len(COLUMNS), parts).when(line.isNotNull(), F.raise_error(F.concat(F.lit("wrong number of columns: "), line)).cast("array<string>"))
    c = {n: F.element_at(right, i + 1) for i, n in enumerate(COLUMNS)}
    typed = {
        "ts": F.to_timestamp_ntz(c["ts"], F.lit(FORMAT)), "from_bank": normalize_bank(c["from_bank"]), "from_account": c["from_account"],
        "to_bank": normalize_bank(c["to_bank"]), "to_account": c["to_account"], "amount_received": c["amount_received"].cast(MONEY),
        "receiving_currency": c["receiving_currency"], "amount_paid": c["amount_paid"].cast(MONEY), "payment_currency": c["payment_currency"],
        "payment_format": c["payment_format"], "is_laundering": c["is_laundering"] == "1",
    }
    return F.struct(*[v.alias(n) for n, v in typed.items()])


def read_transactions(spark: SparkSession, path: str) -> DataFrame:
    """The ledger file with ``txn_id`` by file order from 1."""
    rows = _numbered(spark, path).where("no > 1 AND trim(line) <> ''").select((F.col("no") - 1).alias("txn_id"), _transfer(F.expr("no > 1 AND trim(line) <> ''")).alias("t"))
    return rows.select("txn_id", "t.*")


def read_accounts(spark: SparkSession, path: str) -> DataFrame:
    """(bank_id, account_number, bank_name, entity_id, entity_name), the first line of every bank and account."""
    parts = _fields(F.col("line"))
    names = ("bank_name", "bank_id", "account_number", "entity_id", "entity_name")
    rows = _numbered(spark, path).where("no > 1 AND trim(line) <> ''").select("no", *[F.element_at(parts, i + 1).alias(n) for i, n in enumerate(names)])
    rows = rows.withColumn("bank_id", normalize_bank(F.col("bank_id")))
    first = rows.groupBy("bank_id", "account_number").agg(F.min_by(F.struct("bank_name", "entity_id", "entity_name"), "no").alias("f"))
    return first.select("bank_id", "account_number", *[null_text(F.col(f"f.{n}")).alias(n) for n in ("bank_name", "entity_id", "entity_name")])


def read_patterns(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(patterns, lines) of the label file: blocks between a BEGIN and an END line, numbered from 1; lines outside are left out.

    The file lists labelled rings alone and is read in one task, which its order needs.
    """
    begin, end = r"^BEGIN LAUNDERING ATTEMPT - ([^:]+?)(?::\s*(.*))?\s*$", "^END LAUNDERING ATTEMPT"
    order = Window.orderBy("no")
    rows = _numbered(spark, path).where("trim(line) <> ''").withColumns({"opens": F.col("line").rlike(begin).cast("int"), "closes": F.col("line").rlike(end).cast("int")})
    rows = rows.withColumns({"block": F.sum("opens").over(order), "open": F.sum(F.col("opens") - F.col("closes")).over(order)})
    heads = rows.where("opens = 1").select(F.col("block").cast("int").alias("pattern_id"), F.upper(F.trim(F.regexp_extract("line", begin, 1))).alias("typology"), F.regexp_extract("line", begin, 2).alias("description"))
    lines = rows.where("opens = 0 AND closes = 0 AND open > 0").select(F.col("block").cast("int").alias("pattern_id"), "no", _transfer(F.expr("opens = 0 AND closes = 0 AND open > 0")).alias("t")).select("pattern_id", "no", "t.*")
    n = lines.groupBy("pattern_id").agg(F.count("*").alias("txn_count"))
    return heads.join(n, "pattern_id", "left").withColumn("txn_count", F.coalesce("txn_count", F.lit(0))), lines


_TUPLE = ["ts", "from_bank", "from_account", "to_bank", "to_account", "amount_paid", "payment_format"]


def link_patterns(transactions: DataFrame, lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(transactions with pattern_id, lines with matched_txn_id): the whole tuple must agree; the least id wins on either side."""
    met = lines.select("pattern_id", "no", *_TUPLE).join(transactions.select("txn_id", *_TUPLE), _TUPLE)
    by_txn = met.groupBy("txn_id").agg(F.min("pattern_id").alias("pattern_id"))
    by_line = met.groupBy("no").agg(F.min("txn_id").alias("matched_txn_id"))
    return transactions.join(by_txn, "txn_id", "left"), lines.join(by_line, "no", "left")


def as_ledger(transactions: DataFrame, patterns: DataFrame | None = None) -> DataFrame:
    """Transactions with pattern_id in the form that the operators take; account keys are ``bank|account``."""
    t = transactions if "pattern_id" in transactions.columns else transactions.withColumn("pattern_id", F.lit(None).cast("int"))
    out = t.select("txn_id", "ts", micros(F.col("ts")).alias("ts_us"), F.concat_ws("|", "from_bank", "from_account").alias("src"), F.concat_ws("|", "to_bank", "to_account").alias("dst"), F.col("amount_paid").alias("amount"), "payment_format", "is_laundering", F.coalesce("pattern_id", F.lit(0)).cast("long").alias("pattern_id"))
    if patterns is None:
        return out.withColumn("typology", F.lit(None).cast("string"))
    return out.join(patterns.select(F.col("pattern_id").cast("long").alias("pattern_id"), "typology"), "pattern_id", "left")


def report(transactions: DataFrame) -> DataFrame:
    """One row of load counts."""
    return transactions.agg(F.count("*").alias("txns"), F.count(F.when(F.col("is_laundering"), 1)).alias("laundering"), F.count("pattern_id").alias("labelled"), F.min("amount_paid").alias("least"), F.max("amount_paid").alias("most"))


__all__ = ["SHAPES", "as_ledger", "link_patterns", "read_accounts", "read_patterns", "read_transactions", "report"]
