"""SQL entry point: statements of the dialect over a catalog of immutable tables.

Queries become Spark SQL and run lazily.  INSERT, UPDATE, DELETE and MERGE make a new
version of a table; transactions, savepoints and point-in-time reads keep older versions.
"""

from __future__ import annotations

import copy
import dataclasses
import re
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import json_functions
from skein.operators import approximate, mutation, recursion, similarity, temporal
from skein.plans import dialect
from skein.plans.dialect import OP, Options, W
from skein.plans.tokens import Token, close, find, name_of, render, split, starts, tokenize
from skein.session import dialect_session
from skein.sources import files
from skein.sources.storage import scratch

#: Versions of a table that may stack up before it is written out.
DEPTH = 6


class ConstraintError(ValueError):
    """A change that a constraint forbids."""


@dataclass
class ForeignKey:
    columns: list[str]
    parent: str
    parent_columns: list[str]
    on_delete: str = "RESTRICT"


@dataclass
class Table:
    """One version of a table and what its definition asks of it."""

    df: DataFrame
    not_null: list[str] = field(default_factory=list)
    unique: list[list[str]] = field(default_factory=list)
    checks: list[str] = field(default_factory=list)
    foreign: list[ForeignKey] = field(default_factory=list)
    defaults: dict[str, str] = field(default_factory=dict)
    versions: DataFrame | None = None
    depth: int = 0


@dataclass
class Catalog:
    tables: dict[str, Table] = field(default_factory=dict)
    views: dict[str, str] = field(default_factory=dict)
    materialized: dict[str, str] = field(default_factory=dict)
    procedures: dict[str, str] = field(default_factory=dict)
    indexes: dict[str, tuple[str, list[str]]] = field(default_factory=dict)
    types: dict[str, str] = field(default_factory=dict)
    schemas: set[str] = field(default_factory=set)

    def snapshot(self) -> Catalog:
        return Catalog(*(copy.copy(getattr(self, f)) for f in self.__dataclass_fields__))


class Engine:
    def __init__(self, spark: SparkSession, folders: tuple[str, ...] = ("/tmp",), clock=lambda: int(time.time() * 1000)):
        self.spark = dialect_session(spark)
        self.catalog = Catalog()
        self.folders, self.clock = folders, clock
        self.saved: list[tuple[str, Catalog]] = []
        self.context: dict[str, str] = {}
        self.sf_dir: str | None = None
        json_functions.register(self.spark)

    # -- tables ---------------------------------------------------------------------------------

    def attach(self, sf_dir: str) -> Engine:
        """Make the tables of a data directory known; each is opened when a statement first names it."""
        self.sf_dir = sf_dir
        return self

    def register(self, name: str, df: DataFrame) -> None:
        self._put(name.lower(), Table(df))

    def register_function(self, name: str, function, returns: str) -> None:
        """A Python function for use in SQL; pass a pandas or Arrow UDF for anything but small tables.

        A grouped-aggregate UDF is an aggregate function.  Its groups are whole in a task each, so pre-aggregate with
        built-in functions where a group may be large.
        """
        self.spark.udf.register(name, function) if hasattr(function, "evalType") else self.spark.udf.register(name, function, returns)

    def register_table_function(self, name: str, function) -> None:
        """A Python table function (made with ``pyspark.sql.functions.udtf``) for use in FROM and LATERAL."""
        self.spark.udtf.register(name, function)

    def load_parquet(self, path: str, name: str, columns: list[str] | None = None) -> int:
        self._put(name.lower(), Table(files.read_parquet(self.spark, path, columns)))
        return self.catalog.tables[name.lower()].df.count()

    def load_csv(self, path: str, name: str, header: bool = True) -> int:
        self._put(name.lower(), Table(files.read_csv(self.spark, path, header)))
        return self.catalog.tables[name.lower()].df.count()

    def _put(self, name: str, table: Table) -> None:
        if table.depth >= DEPTH:
            table.df, table.depth = scratch(table.df, "version"), 0
            if table.versions is not None:
                table.versions = scratch(table.versions, "version")
        self.catalog.tables[name] = table
        table.df.createOrReplaceTempView(name)
        self._refresh_views()

    def _refresh_views(self) -> None:
        for name, text in self.catalog.views.items():
            self._open(tokenize(text))
            self.spark.sql(text).createOrReplaceTempView(name)

    def _restore(self, catalog: Catalog) -> None:
        for name in {*self.catalog.tables, *self.catalog.views}:
            self.spark.catalog.dropTempView(name)
        self.catalog = catalog.snapshot()
        for name, table in self.catalog.tables.items():
            table.df.createOrReplaceTempView(name)
        self._refresh_views()

    def table(self, name: str) -> Table:
        self._open([W(name)])
        if name not in self.catalog.tables:
            raise KeyError(f"no table {name}")
        return self.catalog.tables[name]

    def _open(self, tokens: list[Token]) -> None:
        if self.sf_dir:
            for t in tokens:
                name = t.text.strip('"`').lower()
                if t.kind in ("word", "quoted") and name in files.TABLES and name not in self.catalog.tables:
                    self._put(name, Table(files.read_table(self.spark, self.sf_dir, name)))

    # -- statements -----------------------------------------------------------------------------

    def execute(self, sql: str, args: list | dict | None = None) -> DataFrame:
        """Run one statement.  ``args`` are bound values for ``?``, ``$n`` (list) or ``:name`` (dict), never spliced into the text."""
        return self._run(self._qualified(tokenize(sql)), args)

    def script(self, sql: str) -> DataFrame | None:
        """Run statements between semicolons; the last one's result."""
        out = None
        for part in split(tokenize(sql), ";"):
            if part:
                out = self._run(self._qualified(part), None)
        return out

    def _qualified(self, tokens: list[Token]) -> list[Token]:
        """``schema.table`` of a known schema as one name."""
        out, i = [], 0
        while i < len(tokens):
            if i + 2 < len(tokens) and tokens[i].text.lower() in self.catalog.schemas and tokens[i + 1].text == "." and tokens[i + 2].kind == "word":
                out.append(W(f"{tokens[i].text}__{tokens[i + 2].text}".lower()))
                i += 3
            else:
                out.append(tokens[i])
                i += 1
        return out

    def _run(self, tokens: list[Token], args) -> DataFrame:
        if not tokens:
            raise ValueError("an empty statement")
        for words, action in STATEMENTS:
            if starts(tokens, *words):
                return self._query(tokens, args) if action == "_query" else getattr(self, action)(tokens[len(words) :], args)
        raise ValueError(f"cannot run a statement that starts with {tokens[0].text}")

    def _message(self, text: str) -> DataFrame:
        return self.spark.createDataFrame([(text,)], "status string")

    def _affected(self, n: int) -> DataFrame:
        return self.spark.createDataFrame([(n,)], "rows_affected long")

    # -- queries --------------------------------------------------------------------------------

    def _query(self, tokens: list[Token], args=None) -> DataFrame:
        tokens, options = dialect.extensions(tokens)
        self._open(tokens)
        tokens = self._as_of(self._context(tokens))
        recursive = self._recursive(tokens, options)
        if recursive is not None:
            return recursive
        if options.approximate:
            estimated = self._approximate(tokens, options)
            if estimated is not None:
                return estimated
        if options.method in ("HYPERLOGLOG", "HLL"):
            tokens = _approx_distinct(tokens)
        tokens = dialect.query(tokens)
        if options.similar:
            tokens = self._similar(tokens, options)
        text, bound = _bind(render(tokens), args)
        return self.spark.sql(text, args=bound) if bound else self.spark.sql(text)

    def _context(self, tokens: list[Token]) -> list[Token]:
        """SESSION_CONTEXT('key') as its value or NULL."""
        out, i = [], 0
        while i < len(tokens):
            if tokens[i].key == "SESSION_CONTEXT" and i + 3 < len(tokens) and tokens[i + 1].text == "(":
                value = self.context.get(tokens[i + 2].text.strip("'").lower())
                out.append(W("NULL") if value is None else Token("text", "'" + value.replace("'", "''") + "'"))
                i = close(tokens, i + 1) + 1
            else:
                out.append(tokens[i])
                i += 1
        return out

    def _as_of(self, tokens: list[Token]) -> list[Token]:
        """``t FOR SYSTEM_TIME AS OF ms`` (or BETWEEN, ALL) as a view of the versions."""
        out, i = [], 0
        while i < len(tokens):
            if i and tokens[i].key == "FOR" and i + 1 < len(tokens) and tokens[i + 1].key == "SYSTEM_TIME":
                name = name_of([out.pop()])
                versions = self.table(name).versions
                if versions is None:
                    raise ValueError(f"{name} keeps no versions")
                kind = tokens[i + 2].key
                if kind == "AS":
                    df, used, tag = temporal.as_of(versions, int(tokens[i + 4].text)), 5, tokens[i + 4].text
                elif kind == "BETWEEN":
                    df, used, tag = temporal.between(versions, int(tokens[i + 3].text), int(tokens[i + 5].text)), 6, f"{tokens[i + 3].text}_{tokens[i + 5].text}"
                else:
                    df, used, tag = versions, 3, "all"
                view = f"{name}__at_{tag}"
                df.createOrReplaceTempView(view)
                out.append(W(view))
                i += used
            else:
                out.append(tokens[i])
                i += 1
        return out

    def _recursive(self, tokens: list[Token], options: Options) -> DataFrame | None:
        """WITH [RECURSIVE] name AS (anchor UNION ALL step) ..., by semi-naive rounds; None if nothing recurs."""
        if not starts(tokens, "WITH"):
            return None
        at, plain, name = 1 + starts(tokens[1:], "RECURSIVE"), [], None
        while True:
            own = name_of(tokens[at:])
            open_ = at + 1
            columns: list[str] = []
            if tokens[open_].text == "(":
                end = close(tokens, open_)
                columns = [name_of(c) for c in split(tokens[open_ + 1 : end])]
                open_ = end + 1
            open_ += tokens[open_].key == "AS"
            end = close(tokens, open_)
            body = tokens[open_ + 1 : end]
            more = end + 1 < len(tokens) and tokens[end + 1].text == ","
            cut = find(body, "UNION", "ALL")
            if cut >= 0 and any(t.kind == "word" and t.text.lower() == own for t in body[cut:]):
                name = own
                break
            plain.append(tokens[at : end + 1])
            if not more:
                return None
            at = end + 2
        before = [W("WITH"), *[t for i, p in enumerate(plain) for t in ([OP(",")] if i else []) + p]] if plain else []
        anchor = self.spark.sql(render(dialect.query([*before, *body[:cut]])))
        if columns:
            anchor = anchor.toDF(*columns)
        step_sql = render(dialect.query([*before, *body[cut + 2 :]]))

        def step(frontier: DataFrame) -> DataFrame:
            frontier.createOrReplaceTempView(name)
            return self.spark.sql(step_sql)

        limit = recursion.DEFAULT_LIMIT if options.max_recursion is None else options.max_recursion
        recursion.recursive(anchor, step, limit).createOrReplaceTempView(name)
        rest = tokens[end + 2 :] if more else tokens[end + 1 :]
        rest = [W("WITH"), *[t for p in plain for t in [*p, OP(",")]], *rest] if more else [*before, *rest]
        return self._query(rest)

    def _approximate(self, tokens: list[Token], options: Options) -> DataFrame | None:
        """SELECT AVG(column) FROM ... [WHERE ...] within a bound; other queries run exactly."""
        epsilon, confidence = options.approximate
        at = find(tokens, "FROM")
        m = re.fullmatch(r"SELECT AVG\(([\w.`]+)\)(?: AS (\w+))?", render(tokens[:at]), re.I)
        if not m or any(find(tokens, w) >= 0 for w in ("GROUP", "HAVING", "UNION")):
            return None
        base = self.spark.sql(render([W("SELECT"), W(m[1]), W("AS"), W("__v"), *dialect.query(tokens[at:])]))
        return approximate.approx_mean(base, "__v", epsilon, confidence).withColumnRenamed("estimate", m[2] or "estimate")

    def _similar(self, tokens: list[Token], options: Options) -> list[Token]:
        """A Hamming filter on the rows of the (single) table in FROM."""
        column, target, distance = options.similar
        at = find(tokens, "FROM")
        name = name_of(tokens[at + 1 :])
        df = self.spark.table(name)
        column = column or next(f.name for f in df.schema if f.dataType.typeName() == "long")
        view = f"{name}__similar"
        similarity.within_hamming(df, column, target, distance).createOrReplaceTempView(view)
        return [*tokens[: at + 1], W(view), *([] if find(tokens, "AS", start=at) == at + 2 else [W("AS"), W(name)]), *tokens[at + 2 :]]

    # -- definitions ----------------------------------------------------------------------------

    def _create_table(self, tokens, args):
        skip = starts(tokens, "IF", "NOT", "EXISTS")
        tokens = tokens[3:] if skip else tokens
        name = name_of(tokens)
        if name in self.catalog.tables:
            if skip:
                return self._message("exists")
            raise ValueError(f"table {name} exists")
        if starts(tokens[1:], "AS"):
            self._put(name, Table(scratch(self._query(tokens[2:]), "table")))
            return self._message("created")
        end = close(tokens, 1)
        table, columns = Table(None), []
        for part in split(tokens[2:end]):
            self._column(part, table, columns)
        table.df = self.spark.createDataFrame([], ", ".join(f"`{c}` {t}" for c, t in columns))
        if any(t.key == "SYSTEM_VERSIONING" for t in tokens[end:]):
            table.versions = temporal.start(table.df, 0)
        self._put(name, table)
        return self._message("created")

    def _column(self, part: list[Token], table: Table, columns: list) -> None:
        if starts(part, "CONSTRAINT"):
            part = part[2:]
        names = lambda at: [name_of(c) for c in split(part[at + 1 : close(part, at)])]
        if starts(part, "PRIMARY", "KEY"):
            table.unique.append(names(2))
            table.not_null += names(2)
        elif starts(part, "UNIQUE"):
            table.unique.append(names(1))
        elif starts(part, "CHECK"):
            table.checks.append(render(dialect.query(part[2 : close(part, 1)])))
        elif starts(part, "FOREIGN", "KEY"):
            self._references(names(2), part[close(part, 2) + 1 :], table)
        else:
            own, i = name_of(part), 2
            kind = [part[1]]
            if i < len(part) and part[i].text == "(":
                end = close(part, i)
                kind, i = part[1 : end + 1], end + 1
            columns.append((own, dialect.type_text(kind)))
            if kind[0].key == "ENUM":
                table.checks.append(f"`{own}` IN ({render(kind[2:-1])})")
            while i < len(part):
                rest = part[i:]
                if starts(rest, "NOT", "NULL"):
                    table.not_null.append(own)
                    i += 2
                elif starts(rest, "PRIMARY", "KEY"):
                    table.unique.append([own])
                    table.not_null.append(own)
                    i += 2
                elif starts(rest, "UNIQUE"):
                    table.unique.append([own])
                    i += 1
                elif starts(rest, "CHECK"):
                    end = close(part, i + 1)
                    table.checks.append(render(dialect.query(part[i + 2 : end])))
                    i = end + 1
                elif starts(rest, "DEFAULT"):
                    table.defaults[own] = render([part[i + 1]])
                    i += 2
                elif starts(rest, "REFERENCES"):
                    i += self._references([own], rest, table)
                else:
                    i += 1

    def _references(self, columns: list[str], rest: list[Token], table: Table) -> int:
        """Note a foreign key; returns the tokens that it took."""
        parent, used, to = name_of(rest[1:]), 2, columns
        if used < len(rest) and rest[used].text == "(":
            end = close(rest, used)
            to, used = [name_of(c) for c in split(rest[used + 1 : end])], end + 1
        action = "RESTRICT"
        if starts(rest[used:], "ON", "DELETE"):
            action = rest[used + 2].key if rest[used + 2].key != "SET" else "SET NULL"
            used += 3 + (action == "SET NULL") + (rest[used + 2].key == "NO")
        table.foreign.append(ForeignKey(columns, parent, to, action))
        return used

    def _drop_table(self, tokens, args):
        gone = starts(tokens, "IF", "EXISTS")
        name = name_of(tokens[2:] if gone else tokens)
        if self.catalog.tables.pop(name, None) is None and not gone:
            raise KeyError(f"no table {name}")
        self.spark.catalog.dropTempView(name)
        return self._message("dropped")

    def _alter_table(self, tokens, args):
        name, rest = name_of(tokens), tokens[1:]
        t = copy.copy(self.table(name))
        if starts(rest, "ADD"):
            rest = rest[1 + starts(rest[1:], "COLUMN") :]
            new, columns = Table(None), []
            self._column(rest, new, columns)
            (column, kind), default = columns[0], new.defaults.get(columns[0][0], "NULL")
            t.df = t.df.withColumn(column, F.expr(f"CAST({default} AS {kind})"))
            t.defaults = {**t.defaults, **new.defaults}
        elif starts(rest, "DROP"):
            t.df = t.df.drop(name_of(rest[1 + starts(rest[1:], "COLUMN") :]))
        elif starts(rest, "RENAME", "TO"):
            self.catalog.tables.pop(name)
            self.spark.catalog.dropTempView(name)
            name = name_of(rest[2:])
        elif starts(rest, "RENAME"):
            rest = rest[1 + starts(rest[1:], "COLUMN") :]
            t.df = t.df.withColumnRenamed(name_of(rest), name_of(rest[2:]))
        elif starts(rest, "ALTER"):
            rest = rest[1 + starts(rest[1:], "COLUMN") :]
            column = name_of(rest)
            kind = rest[1:] if not starts(rest[1:], "TYPE") else rest[2:]
            t.df = t.df.withColumn(column, F.expr(f"TRY_CAST(`{column}` AS {dialect.type_text(kind)})"))
        else:
            raise ValueError("unknown ALTER TABLE")
        self._put(name, t)
        return self._message("altered")

    def _truncate(self, tokens, args):
        name = name_of(tokens[1:] if starts(tokens, "TABLE") else tokens)
        return self._change(name, mutation.delete(self.table(name).df), 0)

    def _create_schema(self, tokens, args):
        self.catalog.schemas.add(name_of(tokens[3:] if starts(tokens, "IF", "NOT", "EXISTS") else tokens))
        return self._message("created")

    def _create_index(self, tokens, args):
        at = find(tokens, "ON")
        table = name_of(tokens[at + 1 :])
        self.table(table)
        self.catalog.indexes[name_of(tokens)] = table, [name_of(c) for c in split(tokens[at + 3 : close(tokens, at + 2)])]
        return self._message("noted: scans prune by Parquet statistics")

    def _drop_index(self, tokens, args):
        self.catalog.indexes.pop(name_of(tokens))
        return self._message("dropped")

    def _create_view(self, tokens, args):
        at = find(tokens, "AS")
        self._open(tokens)
        text = render(dialect.query(tokens[at + 1 :]))
        name = name_of(tokens)
        self.spark.sql(text).createOrReplaceTempView(name)
        self.catalog.views[name] = text
        return self._message("created")

    def _drop_view(self, tokens, args):
        gone = starts(tokens, "IF", "EXISTS")
        name = name_of(tokens[2:] if gone else tokens)
        if self.catalog.views.pop(name, None) is None and not gone:
            raise KeyError(f"no view {name}")
        self.spark.catalog.dropTempView(name)
        return self._message("dropped")

    def _create_matview(self, tokens, args):
        at = find(tokens, "AS")
        self._open(tokens)
        name, text = name_of(tokens), render(dialect.query(tokens[at + 1 :]))
        self.catalog.materialized[name] = text
        self._put(name, Table(scratch(self.spark.sql(text), "view")))
        return self._message("created")

    def _refresh_matview(self, tokens, args):
        name = name_of(tokens)
        self._put(name, Table(scratch(self.spark.sql(self.catalog.materialized[name]), "view")))
        return self._message("refreshed")

    def _drop_matview(self, tokens, args):
        self.catalog.materialized.pop(name_of(tokens))
        return self._drop_table(tokens, args)

    def _create_procedure(self, tokens, args):
        at = find(tokens, "AS")
        body = tokens[at + 1 :]
        if starts(body, "BEGIN") and body[-1].key == "END":
            body = body[1:-1]
        self.catalog.procedures[name_of(tokens)] = " ".join(t.text for t in body)
        return self._message("created")

    def _drop_procedure(self, tokens, args):
        self.catalog.procedures.pop(name_of(tokens))
        return self._message("dropped")

    def _exec(self, tokens, args):
        """A procedure's statements with @1, @2, ... replaced by literal tokens, so an argument cannot add statements."""
        values = [p for p in split(tokens[1:]) if p]
        out = None
        for part in split(tokenize(self.catalog.procedures[name_of(tokens)]), ";"):
            bound = []
            for t in part:
                if t.kind == "param" and t.text[1:].isdigit():
                    given = values[int(t.text[1:]) - 1]
                    if not all(g.kind in ("number", "text", "hex") or g.key in ("-", "NULL", "TRUE", "FALSE") for g in given):
                        raise ValueError("a procedure's arguments must be literals")
                    bound += given
                else:
                    bound.append(t)
            if bound:
                out = self._run(self._qualified(bound), None)
        return out

    def _create_function(self, tokens, args):
        """A scalar SQL function: name (argument type, ..) RETURNS type [AS [BEGIN]] RETURN expression [END]."""
        name, end = name_of(tokens), close(tokens, 1)
        given = []
        for part in split(tokens[2:end]):
            if part:
                given.append(f"{part[0].text.lstrip('@')} {dialect.type_text(part[1:])}")
        at, start = find(tokens, "RETURN", start=end + 1), find(tokens, "RETURNS", start=end + 1)
        kind = tokens[start + 1 : at]
        stop = next((i for i, t in enumerate(kind) if t.key in ("AS", "BEGIN")), len(kind))
        body = tokens[at + 1 :]
        if body[-1].key == "END" and any(t.key == "BEGIN" for t in kind):
            body = body[:-1]
        body = [W(t.text[1:]) if t.kind == "param" and t.text[0] == "@" else t for t in body if t.text != ";"]
        self.spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({', '.join(given)}) RETURNS {dialect.type_text(kind[:stop])} RETURN {render(dialect.query(body))}")
        return self._message("created")

    def _create_type(self, tokens, args):
        """A table type: the schema that :meth:`table_value` gives to literal rows."""
        at = find(tokens, "TABLE")
        columns: list = []
        for part in split(tokens[at + 2 : close(tokens, at + 1)]):
            self._column(part, Table(None), columns)
        self.catalog.types[name_of(tokens)] = ", ".join(f"`{c}` {t}" for c, t in columns)
        return self._message("created")

    def table_value(self, kind: str, name: str, rows: list[tuple]) -> None:
        """Make ``rows`` of a table type known as a table."""
        self._put(name.lower(), Table(files.values(self.spark, rows, self.catalog.types[kind.lower()])))

    # -- changes --------------------------------------------------------------------------------

    def _change(self, name: str, df: DataFrame, n: int, came: DataFrame | None = None) -> DataFrame:
        """A new version of ``name`` once its constraints hold; if only rows ``came``, the others are neither checked nor versioned anew."""
        t = copy.copy(self.table(name))
        before, t.df, t.depth = t.df, df, t.depth + 1
        if came is None:
            self._validate(name, t)
        else:
            self._validate(name, dataclasses.replace(t, df=came))
            for keys in t.unique:
                if not came.join(before.select(*keys), keys, "left_semi").isEmpty():
                    raise ConstraintError(f"{name}: {keys} not unique")
        if t.versions is not None:
            t.versions = temporal.apply(t.versions, df, self.clock()) if came is None else t.versions.unionByName(temporal.start(came, self.clock()))
        self._put(name, t)
        return self._affected(n)

    def _validate(self, name: str, t: Table) -> None:
        if t.not_null and not mutation.null_violations(t.df, t.not_null).isEmpty():
            raise ConstraintError(f"{name}: NULL in {t.not_null}")
        for keys in t.unique:
            if not mutation.unique_violations(t.df, keys).isEmpty():
                raise ConstraintError(f"{name}: {keys} not unique")
        for check in t.checks:
            if not mutation.check_violations(t.df, check).isEmpty():
                raise ConstraintError(f"{name}: CHECK ({check}) fails")
        for f in t.foreign:
            if f.parent in self.catalog.tables and not mutation.foreign_key_violations(t.df, f.columns, self.catalog.tables[f.parent].df, f.parent_columns).isEmpty():
                raise ConstraintError(f"{name}: {f.columns} has no {f.parent}")

    def _where(self, tokens: list[Token]):
        at = find(tokens, "WHERE")
        return (tokens[:at], render(dialect.query(tokens[at + 1 :]))) if at >= 0 else (tokens, None)

    def _returning(self, tokens: list[Token]):
        at = find(tokens, "RETURNING")
        return (tokens[:at], render(tokens[at + 1 :])) if at >= 0 else (tokens, None)

    def _pick(self, rows: DataFrame, columns: str) -> DataFrame:
        rows.createOrReplaceTempView("__returned")
        return self.spark.sql(f"SELECT {columns} FROM __returned")

    def _insert(self, tokens, args):
        tokens, returning = self._returning(tokens)
        self._open(tokens)
        name, rest = name_of(tokens), tokens[1:]
        t = self.table(name)
        columns = t.df.columns
        if rest[0].text == "(" and not starts(rest[1:], "SELECT"):
            end = close(rest, 0)
            columns, rest = [name_of(c) for c in split(rest[1:end])], rest[end + 1 :]
        conflict = find(rest, "ON", "CONFLICT")
        rest, clause = (rest[:conflict], rest[conflict + 2 :]) if conflict >= 0 else (rest, None)
        text, bound = _bind(render(dialect.query(rest)), args)
        rows = (self.spark.sql(text, args=bound) if bound else self.spark.sql(text)).toDF(*columns)
        for c, default in t.defaults.items():
            if c not in columns:
                rows = rows.withColumn(c, F.expr(default))
        rows = mutation.insert(t.df.limit(0), rows)
        n = rows.count()
        if clause is None:
            rows = scratch(rows, "inserted")
            self._change(name, mutation.insert(t.df, rows), n, came=rows)
        else:
            self._conflict(name, t, rows, clause)
        return self._pick(rows, returning) if returning else self._affected(n)

    def _conflict(self, name: str, t: Table, rows: DataFrame, clause: list[Token]) -> None:
        if clause[0].text == "(":
            keys, clause = [name_of(c) for c in split(clause[1 : close(clause, 0)])], clause[close(clause, 0) + 1 :]
        else:
            keys = t.unique[0]
        if starts(clause, "DO", "NOTHING"):
            self._change(name, mutation.upsert(t.df, rows, keys, replace=False), 0)
            return
        sets = _assignments(clause[find(clause, "SET") + 1 :])
        sets = {c: re.sub(r"\bexcluded\.", "s.", re.sub(rf"\b{name}\.", "t.", e, flags=re.I), flags=re.I) for c, e in sets.items()}
        self._change(name, mutation.merge(t.df, rows, keys, sets), 0)

    def _update(self, tokens, args):
        tokens, returning = self._returning(tokens)
        self._open(tokens)
        head, where = self._where(tokens)
        name = name_of(head)
        t = self.table(name)
        sets = _assignments(head[find(head, "SET") + 1 :])
        where, bound = _bind(where or "TRUE", args)
        hit = f"coalesce(({where}), false)"
        columns = ", ".join(f"CASE WHEN {hit} THEN CAST(({sets[c]}) AS {kind}) ELSE `{c}` END AS `{c}`" if c in sets else f"`{c}`" for c, kind in t.df.dtypes)
        run = (lambda q: self.spark.sql(q, args=bound)) if bound else self.spark.sql
        n = run(f"SELECT count(*) AS n FROM {name} WHERE {where}").first().n
        after = run(f"SELECT {columns} FROM {name}")
        changed = run(f"SELECT {columns} FROM {name} WHERE {where}") if returning else None
        changed = scratch(changed, "returned") if returning else None
        self._change(name, after, n)
        return self._pick(changed, returning) if returning else self._affected(n)

    def _delete(self, tokens, args):
        tokens, returning = self._returning(tokens)
        self._open(tokens)
        head, where = self._where(tokens)
        name = name_of(head)
        where, bound = _bind(where or "TRUE", args)
        run = (lambda q: self.spark.sql(q, args=bound)) if bound else self.spark.sql
        gone = run(f"SELECT * FROM {name} WHERE {where}")
        n = gone.count()
        gone = scratch(gone, "returned") if returning else gone
        for child, t in list(self.catalog.tables.items()):
            for f in t.foreign:
                if f.parent == name:
                    self._on_delete(child, t, f, gone)
        self._change(name, run(f"SELECT * FROM {name} WHERE ({where}) IS NOT TRUE"), n)
        return self._pick(gone, returning) if returning else self._affected(n)

    def _on_delete(self, child: str, t: Table, f: ForeignKey, gone: DataFrame) -> None:
        keys = gone.select(*[F.col(p).alias(f"_p{i}") for i, p in enumerate(f.parent_columns)]).distinct()
        same = None
        for i, c in enumerate(f.columns):
            one = F.col(c) == F.col(f"_p{i}")
            same = one if same is None else same & one
        if f.on_delete == "CASCADE":
            after = t.df.join(keys, same, "left_anti")
        elif f.on_delete == "SET NULL":
            hit = t.df.join(keys.withColumn("_hit", F.lit(True)), same, "left")
            after = hit.select(*[F.when(F.col("_hit").isNull(), F.col(c)).alias(c) if c in f.columns else F.col(c) for c in t.df.columns])
        elif not t.df.join(keys, same, "left_semi").isEmpty():
            raise ConstraintError(f"{child} refers to rows of {f.parent}")
        else:
            return
        now = copy.copy(t)
        now.df = scratch(after, "version")
        self._put(child, now)

    def _merge(self, tokens, args):
        """MERGE INTO t USING (VALUES ..|SELECT ..|table) AS s ON .. WHEN .. THEN .., as one full outer join."""
        self._open(tokens)
        name, at = name_of(tokens), find(tokens, "USING")
        t = self.table(name)
        alias = name_of(tokens[1 + (tokens[1].key == "AS") :]) if at > 1 else name
        at += 1
        if tokens[at].text == "(":
            end = close(tokens, at)
            source, at = render(dialect.query(tokens[at + 1 : end])), end + 1
        else:
            source, at = f"SELECT * FROM {name_of(tokens[at:])}", at + 1
        on = find(tokens, "ON", start=at)
        tag = [x for x in tokens[at:on] if x.key != "AS"]
        s_alias = name_of(tag) if tag else name_of(tokens[at - 1 :])
        rows = self.spark.sql(source)
        if len(tag) > 1:
            rows = rows.toDF(*[name_of(c) for c in split(tag[2:-1])])
        whens = [i for i in range(on, len(tokens)) if tokens[i].key == "WHEN" and (tokens[i + 1].key == "MATCHED" or tokens[i + 1].key == "NOT")]
        condition = render(dialect.query(tokens[on + 1 : whens[0]]))
        clauses = [tokens[i:j] for i, j in zip(whens, [*whens[1:], len(tokens)], strict=True)]
        scratch(t.df.withColumn("__t", F.monotonically_increasing_id()), "target").createOrReplaceTempView("__target")
        rows.withColumn("__s", F.lit(True)).createOrReplaceTempView("__source")
        fresh, stale, both = "__t IS NULL", "__s IS NULL", "(__t IS NOT NULL AND __s)"
        action, values = [], {c: [] for c in t.df.columns}
        for n, c in enumerate(clauses):
            then = find(c, "THEN")
            head, body = c[1:then], c[then + 1 :]
            kind = both if starts(head, "MATCHED") else stale if starts(head, "NOT", "MATCHED", "BY", "SOURCE") else fresh
            extra = find(head, "AND")
            kind = f"({kind} AND coalesce(({render(dialect.query(head[extra + 1 :]))}), false))" if extra >= 0 else f"({kind})"
            if starts(body, "DELETE"):
                action.append(f"WHEN {kind} THEN -{n + 1}")
            elif starts(body, "UPDATE"):
                action.append(f"WHEN {kind} THEN {n + 1}")
                for column, e in _assignments(body[2:]).items():
                    values[column.split(".")[-1]].append((n + 1, e))
            else:
                action.append(f"WHEN {kind} THEN {n + 1}")
                columns, rest = t.df.columns, body[1:]
                if rest and rest[0].text == "(":
                    end = close(rest, 0)
                    columns, rest = [name_of(x) for x in split(rest[1:end])], rest[end + 1 :]
                given = [render(dialect.query(e)) for e in split(rest[2 : close(rest, 1)])]
                for column, e in {**dict.fromkeys(t.df.columns, "NULL"), **t.defaults, **dict(zip(columns, given, strict=True))}.items():
                    values[column].append((n + 1, e))
        join = f"__target AS {alias} FULL OUTER JOIN __source AS {s_alias} ON {condition}"
        act = f"(CASE {' '.join(action)} ELSE 0 END)"

        def when(n: int) -> str:  # the branch's own condition, after those that come before it
            return f"{act} = {n}"

        picked = ", ".join("CASE " + " ".join(f"WHEN {when(n)} THEN CAST({e} AS {kind})" for n, e in values[c]) + f" ELSE {alias}.`{c}` END AS `{c}`" if values[c] else f"{alias}.`{c}` AS `{c}`" for c, kind in t.df.dtypes)
        result = scratch(self.spark.sql(f"SELECT {picked}, {act} AS __a, __t FROM {join}"), "merge")
        if not result.where("__t IS NOT NULL AND __a <> 0").groupBy("__t").count().where("count > 1").isEmpty():
            raise ConstraintError(f"{name}: several source rows of the MERGE change one row")
        n = result.where("__a <> 0").count()
        self._change(name, result.where("__a > 0 OR (__a = 0 AND __t IS NOT NULL)").drop("__a", "__t"), n)
        return self._affected(n)

    # -- the rest -------------------------------------------------------------------------------

    def _begin(self, tokens, args):
        self.saved = [("", self.catalog.snapshot())]
        return self._message("begun")

    def _commit(self, tokens, args):
        self.saved = []
        return self._message("committed")

    def _rollback(self, tokens, args):
        name = name_of(tokens[1 + starts(tokens[1:], "SAVEPOINT") :]) if starts(tokens, "TO") else ""
        if not self.saved:
            raise ValueError("no transaction is open")
        while self.saved[-1][0] != name:
            self.saved.pop()
        self._restore(self.saved[-1][1])
        if not name:
            self.saved = []
        return self._message("rolled back")

    def _savepoint(self, tokens, args):
        self.saved.append((name_of(tokens), self.catalog.snapshot()))
        return self._message("saved")

    def _release(self, tokens, args):
        name = name_of(tokens[starts(tokens, "SAVEPOINT") :])
        self.saved = [s for s in self.saved if s[0] != name]
        return self._message("released")

    def _explain(self, tokens, args):
        plan = self._query(tokens, args)._jdf.queryExecution().optimizedPlan().toString()
        return self.spark.createDataFrame([(line,) for line in plan.rstrip().split("\n")], "plan string")

    def _analyze(self, tokens, args):
        """Run the query; its rows count and time."""
        began = time.time()
        n = self._run(tokens, args).count()
        return self.spark.createDataFrame([(n, (time.time() - began) * 1000)], "rows long, execution_time_ms double")

    def _show_tables(self, tokens, args):
        names = sorted({*self.catalog.tables, *self.catalog.views})
        return self.spark.createDataFrame([(n,) for n in names], "table_name string")

    def _vacuum(self, tokens, args):
        """Write each table's current version out, so that its history no longer needs computing."""
        for name, t in list(self.catalog.tables.items()):
            if t.depth:
                t = copy.copy(t)
                t.df, t.depth = scratch(t.df, "version"), 0
                self._put(name, t)
        return self._message("vacuumed")

    def _copy(self, tokens, args):
        name, way = name_of(tokens), tokens[1].key
        path = files.allowed(tokens[2].text[1:-1], self.folders)
        if way == "TO":
            return self._affected(files.copy_to(self.table(name).df, path))
        rows = files.copy_from(self.spark, path, self.table(name).df.schema)
        return self._change(name, mutation.insert(self.table(name).df, rows), rows.count())

    def _backup(self, tokens, args):
        folder = files.allowed(tokens[0].text[1:-1], self.folders)
        files.save_snapshot({n: t.df for n, t in self.catalog.tables.items()}, f"{folder}/{self.clock():020d}")
        return self._message("saved")

    def _restore_from(self, tokens, args):
        """The newest backup, or the newest not after AS OF TIMESTAMP ms."""
        folder = files.allowed(tokens[0].text[1:-1], self.folders)
        at = find(tokens, "TIMESTAMP")
        limit = int(tokens[at + 1].text.strip("'")) if at >= 0 else 1 << 62
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(folder)
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        times = [int(s.getPath().getName()) for s in fs.listStatus(path) if s.getPath().getName().isdigit()]
        best = max(t for t in times if t <= limit)
        root = jvm.org.apache.hadoop.fs.Path(f"{folder}/{best:020d}")
        names = [s.getPath().getName() for s in fs.listStatus(root)]
        for name, df in files.load_snapshot(self.spark, f"{folder}/{best:020d}", names).items():
            t = copy.copy(self.catalog.tables.get(name, Table(df)))
            t.df, t.depth = df, 0
            self._put(name, t)
        return self._message("restored")

    def _set(self, tokens, args):
        at = find(tokens, "=")
        self.context[render(tokens[:at]).lower()] = tokens[at + 1].text.strip("'").replace("''", "'")
        return self._message("set")


#: First words of a statement and the method that runs it, longest first.
STATEMENTS = sorted(
    [
        (("SELECT",), "_query"), (("WITH",), "_query"), (("VALUES",), "_query"), (("(",), "_query"), (("CREATE", "TABLE"), "_create_table"), (("DROP", "TABLE"), "_drop_table"),
        (("ALTER", "TABLE"), "_alter_table"), (("TRUNCATE",), "_truncate"), (("CREATE", "SCHEMA"), "_create_schema"), (("CREATE", "INDEX"), "_create_index"),
        (("CREATE", "UNIQUE", "INDEX"), "_create_index"), (("DROP", "INDEX"), "_drop_index"), (("CREATE", "VIEW"), "_create_view"), (("CREATE", "OR", "REPLACE", "VIEW"), "_create_view"),
        (("DROP", "VIEW"), "_drop_view"), (("CREATE", "MATERIALIZED", "VIEW"), "_create_matview"), (("REFRESH", "MATERIALIZED", "VIEW"), "_refresh_matview"),
        (("DROP", "MATERIALIZED", "VIEW"), "_drop_matview"), (("CREATE", "PROCEDURE"), "_create_procedure"), (("CREATE", "OR", "ALTER", "PROCEDURE"), "_create_procedure"),
        (("DROP", "PROCEDURE"), "_drop_procedure"), (("CREATE", "FUNCTION"), "_create_function"), (("CREATE", "OR", "ALTER", "FUNCTION"), "_create_function"), (("CREATE", "TYPE"), "_create_type"), (("EXEC",), "_exec"), (("EXECUTE",), "_exec"), (("INSERT", "INTO"), "_insert"), (("UPDATE",), "_update"), (("DELETE", "FROM"), "_delete"),
        (("MERGE", "INTO"), "_merge"), (("MERGE",), "_merge"), (("BEGIN", "TRANSACTION"), "_begin"), (("BEGIN",), "_begin"), (("COMMIT",), "_commit"), (("ROLLBACK",), "_rollback"),
        (("SAVEPOINT",), "_savepoint"), (("RELEASE",), "_release"), (("EXPLAIN",), "_explain"), (("ANALYZE",), "_analyze"), (("EXPLAIN", "ANALYZE"), "_analyze"),
        (("SHOW", "TABLES"), "_show_tables"), (("VACUUM",), "_vacuum"), (("COPY",), "_copy"), (("BACKUP", "TO"), "_backup"), (("RESTORE", "FROM"), "_restore_from"), (("SET",), "_set"),
    ],
    key=lambda x: -len(x[0]),
)


def _assignments(tokens: list[Token]) -> dict[str, str]:
    out = {}
    for part in split(tokens):
        at = find(part, "=")
        out[part[at - 1].text.strip('"`').lower()] = render(dialect.query(part[at + 1 :]))
    return out


def _bind(text: str, args) -> tuple[str, list | dict | None]:
    """``$n`` as positional marks in order of use; values go to Spark as bound arguments."""
    if args is None:
        return text, None
    if isinstance(args, dict):
        return text, args
    order: list = []

    def mark(m: re.Match) -> str:
        if m[0][0] == "'":
            return m[0]
        order.append(args[int(m[0][1:]) - 1] if m[0] != "?" else args[len(order)])
        return "?"

    return re.sub(r"'(?:[^'\\]|\\.|'')*'|\$\d+|\?", mark, text, flags=re.S), order


def _approx_distinct(tokens: list[Token]) -> list[Token]:
    """COUNT(DISTINCT x) as a HyperLogLog estimate."""
    out, i = [], 0
    while i < len(tokens):
        if [t.key for t in tokens[i : i + 3]] == ["COUNT", "(", "DISTINCT"]:
            end = close(tokens, i + 1)
            out += [W("approx_count_distinct"), OP("("), *tokens[i + 3 : end], OP(","), Token("number", "0.0081"), OP(")")]
            i = end + 1
        else:
            out.append(tokens[i])
            i += 1
    return out
