"""Queries over the tokens of log lines: projection, one-predicate filters, gathering by ordinal.

Rows come in two modes. "line" correlates the tokens of one line, which needs no shuffle while they are
arrays on the line. "positional" correlates the nth tokens of each type in a file: ordinals are counted in
chunks of lines, so that no file is sorted in one task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logsense.functions.extract import extract, once, restore
from logsense.functions.patterns import COLUMNS
from logsense.functions.typed import EPSILON, RENDERED, STORED, VALUES, literal

OPERATORS = ("=", "!=", "<", "<=", ">", ">=", "~", "^", "$")
#: Lines whose ordinals are counted in one task.
CHUNK = 1 << 20


def resolve(name: str) -> str:
    """Token type of a column."""
    if name not in COLUMNS:
        raise ValueError(f"unknown column: {name}")
    return COLUMNS[name]


def of_kind(tokens: Column, *names: str) -> Column:
    """The tokens of some columns."""
    kinds = [resolve(n) for n in names]
    return F.filter(tokens, lambda t: t["ptype"].isin(kinds))


def _zipped(name: str) -> Column:
    """Tokens of a stored column."""
    pairs = F.arrays_zip(F.col(f"{name}_at").alias("at"), F.col(name).alias("text"))
    return F.transform(pairs, lambda z: F.struct(z["at"].alias("tok_no"), F.lit(resolve(name)).alias("ptype"), z["text"].alias("text")))


def render(name: str, text: Column) -> Column:
    """A token as a result shows it."""
    return RENDERED.get(name, lambda t: t)(text)


def predicate(name: str, op: str, value: str, x: Column) -> Column:
    """Comparison of a column's typed value with a literal; ~ contains, ^ starts with, $ ends with."""
    if op not in OPERATORS:
        raise ValueError(f"unknown operator: {op}")
    resolve(name)
    if op in "~^$":
        if name in VALUES:
            return F.lit(False)
        return {"~": x.contains, "^": x.startswith, "$": x.endswith}[op](value)
    y = F.lit(literal(name, value)).cast(STORED[name])
    if name == "numbers" and op in ("=", "!="):
        same = F.abs(x - y) < F.lit(EPSILON)
        return same if op == "=" else ~same
    return {"=": x == y, "!=": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]


def possible(name: str, op: str, value: str) -> Column:
    """What the least and greatest value of a stored line must satisfy if any of its values compares as asked: for the scan."""
    lo, hi = F.col(f"{name}_lo"), F.col(f"{name}_hi")
    if op in "~$!=" and op != "=" or op == "^" and name in VALUES:
        return lo.isNotNull()
    if op == "^":
        return (hi >= value) & lo.isNotNull()
    y = literal(name, value)
    low, high = (y - 1, y + 1) if name == "numbers" and op == "=" else (y, y)
    low, high = F.lit(low).cast(STORED[name]), F.lit(high).cast(STORED[name])
    return {"=": (lo <= high) & (hi >= low), "<": lo < high, "<=": lo <= high, ">": hi > low, ">=": hi >= low}[op]


def parse_filter(text: str) -> tuple[str, str, str]:
    """Column, operator and literal of "col OP value": the earliest operator splits, the longer one first."""
    at = min((k for k in range(len(text)) if text[k] in "=<>~^$" or text[k : k + 2] == "!="), default=-1)
    if at < 0:
        raise ValueError(f"no operator in: {text}")
    op = text[at : at + 2] if text[at : at + 2] in ("!=", ">=", "<=") else text[at]
    return text[:at].strip(), op, text[at + len(op) :].strip()


class LogTable:
    """Tokens of lines (file, line_no, text); of a stored table, only the columns that a query names are read."""

    def __init__(self, lines: DataFrame):
        self.lines, self.stored = extract(lines.select("file", "line_no", "text"), wanted=("tokens",)), False

    @classmethod
    def of_columns(cls, lines: DataFrame) -> LogTable:
        """A table over stored lines, which have an array of texts, of places and of values for each column."""
        out = cls.__new__(cls)
        out.lines, out.stored = lines, True
        return out

    def _texts(self, name: str) -> Column:
        own = of_kind(F.col("tokens"), name)
        return F.col(name) if self.stored else F.transform(own, lambda t: t["text"])

    def _values(self, name: str) -> Column:
        if name not in VALUES:
            return self._texts(name)
        return F.col(f"{name}_v") if self.stored else F.transform(self._texts(name), VALUES[name])

    def _tokens(self, names: tuple[str, ...]) -> Column:
        if self.stored:
            return F.sort_array(F.concat(*[_zipped(n) for n in names or COLUMNS]))
        return of_kind(F.col("tokens"), *names) if names else F.col("tokens")

    def tokens(self, *names: str) -> DataFrame:
        """Long form: file, line_no, tok_no, ptype, text; of the columns named, or all."""
        x = self.lines.select("file", "line_no", F.explode_outer(self._tokens(names)).alias("t")).where("t is not null")
        return x.select("file", "line_no", "t.tok_no", "t.ptype", "t.text")

    def texts(self) -> DataFrame:
        """file, line_no and text of the stored lines, byte for byte."""
        x = once(self.lines, __tokens=self._tokens(()))
        return x.select("file", "line_no", restore(F.col("literals"), F.col("__tokens")).alias("text"))

    def ordinals(self, *names: str) -> DataFrame:
        """tokens() with `ord`, each token's place among those of its type in the file, from 0."""
        t = self.tokens(*names).withColumn("chunk", F.floor(F.col("line_no") / CHUNK))
        w = Window.partitionBy("file", "ptype").orderBy("chunk")
        base = t.groupBy("file", "ptype", "chunk").agg(F.count(F.lit(1)).alias("n")).withColumn("base", F.sum("n").over(w) - F.col("n")).drop("n")
        within = Window.partitionBy("file", "ptype", "chunk").orderBy("line_no", "tok_no")
        t = t.withColumn("k", F.row_number().over(within))
        return t.join(base, ["file", "ptype", "chunk"]).select("file", "ptype", "line_no", "tok_no", "text", (F.col("base") + F.col("k") - 1).alias("ord"))

    def _first(self, name: str) -> Column:
        return F.get(self._texts(name), F.lit(0))

    def select_column(self, name: str) -> DataFrame:
        """All values of one column, in file order by ord."""
        return self.ordinals(name).select("file", "ord", render(name, F.col("text")).alias(name))

    def select_columns(self, *names: str, mode: str = "line") -> DataFrame:
        """Rows of several columns; a value that is missing is null."""
        if mode == "line":
            x = once(self.lines, **{f"__{n}": self._first(n) for n in names})
            return x.select("file", "line_no", *[render(n, F.col(f"__{n}")).alias(n) for n in names])
        return self.ordinals(*names).groupBy("file", "ord").agg(*self._cells(names))

    @staticmethod
    def _cells(names) -> list[Column]:
        """The value of each column at an ordinal."""
        return [F.max(F.when(F.col("ptype") == resolve(n), render(n, F.col("text")))).alias(n) for n in names]

    def filter(self, name: str, op: str, value: str) -> DataFrame:
        """Ordinals of the values of a column that compare as asked."""
        value_of = VALUES.get(name, lambda t: t)
        return self.ordinals(name).where(predicate(name, op, value, value_of(F.col("text")))).select("file", "ord")

    def filter_by(self, name: str, test: Callable[[Column], Column]) -> DataFrame:
        """Ordinals of the values that an arbitrary predicate (a column expression or a UDF) accepts."""
        return self.ordinals(name).where(test(render(name, F.col("text")))).select("file", "ord")

    def query(self, names: list[str], name: str, op: str, value: str, mode: str = "line") -> DataFrame:
        """Columns of the rows whose value of one column compares as asked."""
        if mode == "line":
            hit = F.exists(self._values(name), lambda x: predicate(name, op, value, x))
            lines = self.lines.where(possible(name, op, value)) if self.stored else self.lines
            out = LogTable.of_columns(lines.where(hit))
            out.stored = self.stored
            return out.select_columns(*names)
        value_of, own = VALUES.get(name, lambda t: t), F.col("ptype") == resolve(name)
        hit = F.max(F.when(own, predicate(name, op, value, value_of(F.col("text"))))).alias("__hit")
        return self.ordinals(*dict.fromkeys([*names, name])).groupBy("file", "ord").agg(hit, *self._cells(names)).where("__hit").drop("__hit")

    def select_at(self, name: str, places: list[int]) -> DataFrame:
        """Values at ordinals, in the order given; repeats stay, places outside are dropped."""
        spark = self.lines.sparkSession
        at = spark.createDataFrame(list(enumerate(places)), "pos long, ord long")
        return self.select_column(name).join(F.broadcast(at), "ord").select("file", "pos", "ord", name)

    def stats(self) -> DataFrame:
        """Values of each column that has any: column, row_count."""
        n = self.lines.agg(*[F.coalesce(F.sum(F.size(F.col(f"{c}_at") if self.stored else self._texts(c))), F.lit(0)).alias(c) for c in COLUMNS])
        return n.unpivot([], list(COLUMNS), "column", "row_count").where("row_count > 0")

    def columns(self) -> list[str]:
        """Names of the columns that have values."""
        found = {r["column"] for r in self.stats().collect()}
        return [c for c in COLUMNS if c in found]

    def has_column(self, name: str) -> bool:
        return name in self.columns()


def column_values(rows: DataFrame, name: str) -> DataFrame:
    """The values of one column of a result, without missing ones."""
    return rows.where(F.col(name).isNotNull()).select(name)


class QueryBuilder:
    """select(...).where(...).limit(n).run(); the last filter holds, none selects all."""

    def __init__(self, table: LogTable, mode: str = "line"):
        self.table, self.mode = table, mode
        self.names, self.test, self.n = ["log_levels", "ipv4", "timestamps"], None, None

    def select(self, *names: str) -> QueryBuilder:
        self.names = list(names)
        return self

    def where(self, text: str) -> QueryBuilder:
        self.test = parse_filter(text)
        return self

    def limit(self, n: int) -> QueryBuilder:
        self.n = n
        return self

    def run(self) -> DataFrame:
        t = self.table
        out = t.query(self.names, *self.test, mode=self.mode) if self.test else t.select_columns(*self.names, mode=self.mode)
        return out if self.n is None else out.orderBy("file", "ord" if self.mode == "positional" else "line_no").limit(self.n)
