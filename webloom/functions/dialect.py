"""One expression, two engines: SQL text for Spark and for DuckDB.

Operators that are plain relational algebra are written once against this class. Spark's text is what the
engine runs (and what Catalyst plans); DuckDB's is the check. Only what differs between the engines is here.
"""

from __future__ import annotations


class Spark:
    name = "spark"

    def lit(self, s: str) -> str:
        return "'" + s.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"

    def rlike(self, x: str, pattern: str) -> str:
        return f"({x} RLIKE {self.lit(pattern)})"

    def extract(self, x: str, pattern: str, group: int = 1) -> str:
        return f"regexp_extract({x}, {self.lit(pattern)}, {group})"

    def extract_all(self, x: str, pattern: str, group: int = 1) -> str:
        return f"regexp_extract_all({x}, {self.lit(pattern)}, {group})"

    def replace(self, x: str, pattern: str, to: str = "") -> str:
        return f"regexp_replace({x}, {self.lit(pattern)}, {self.lit(to)})"

    def array(self, items: list[str]) -> str:
        return f"array({', '.join(items)})"

    def exists(self, xs: str, v: str, cond: str) -> str:
        return f"exists({xs}, {v} -> {cond})"

    def filter(self, xs: str, v: str, cond: str) -> str:
        return f"filter({xs}, {v} -> {cond})"

    def transform(self, xs: str, v: str, to: str) -> str:
        return f"transform({xs}, {v} -> {to})"

    def fold(self, xs: str, a: str, x: str, step: str) -> str:
        """Strings folded into one that begins empty."""
        return f"aggregate({xs}, CAST('' AS STRING), ({a}, {x}) -> {step})"

    def let(self, name: str, value: str, body: str) -> str:
        """body with a name for a value that it uses often."""
        return f"element_at(transform(array({value}), {name} -> {body}), 1)"

    def decoded(self, x: str) -> str:
        """Percent-decoded text of a form; as it is where that is no text."""
        return f"coalesce(try_url_decode({x}), {x})"

    def encoded(self, x: str) -> str:
        return f"url_encode({x})"

    def size(self, xs: str) -> str:
        return f"CAST(size({xs}) AS BIGINT)"

    def join(self, xs: str, sep: str) -> str:
        return f"array_join({xs}, {self.lit(sep)})"

    def split(self, x: str, sep: str) -> str:
        import re

        return f"split({x}, {self.lit(re.escape(sep))}, -1)"

    def at(self, xs: str, i: str | int) -> str:
        """1-based; null where there is none."""
        return f"try_element_at({xs}, {i})"

    def distinct(self, xs: str) -> str:
        return f"array_distinct({xs})"

    def starts(self, x: str, y: str) -> str:
        return f"startswith({x}, {y})"

    def ends(self, x: str, y: str) -> str:
        return f"endswith({x}, {y})"

    def octets(self, x: str) -> str:
        return f"CAST(octet_length({x}) AS BIGINT)"

    def explode(self, base: str, columns: str, xs: str, name: str = "x") -> str:
        return f"SELECT {columns}, CAST(pos AS BIGINT) AS pos, {name} FROM ({base}) LATERAL VIEW posexplode({xs}) e AS pos, {name}"

    def once(self, base: str, columns: str, expression: str, name: str) -> str:
        """A column whose expression is planned and evaluated once, however often the column is used."""
        return f"SELECT {columns}, {name} FROM ({base}) LATERAL VIEW explode(array({expression})) o AS {name}"

    def micros(self, ts: str) -> str:
        return f"unix_micros(CAST({ts} AS TIMESTAMP))"

    def ordered(self, x: str, sep: str, by: str) -> str:
        """Aggregate: the values of x joined in the order of by (a non-null string or number)."""
        return f"array_join(transform(array_sort(collect_list(struct({by} AS k, CAST({x} AS STRING) AS v))), s -> s.v), {self.lit(sep)})"

    def json_text(self, x: str, key: str) -> str:
        return f"get_json_object({x}, '$.{key}')"


class Duck(Spark):
    name = "duckdb"

    def lit(self, s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    def rlike(self, x: str, pattern: str) -> str:
        return f"regexp_matches({x}, {self.lit(pattern)})"

    def replace(self, x: str, pattern: str, to: str = "") -> str:
        import re

        return f"regexp_replace({x}, {self.lit(pattern)}, {self.lit(re.sub(r'[$](\d)', r'\\\1', to))}, 'g')"

    def array(self, items: list[str]) -> str:
        return f"[{', '.join(items)}]"

    def exists(self, xs: str, v: str, cond: str) -> str:
        return f"(len(list_filter({xs}, lambda {v}: {cond})) > 0)"

    def filter(self, xs: str, v: str, cond: str) -> str:
        return f"list_filter({xs}, lambda {v}: {cond})"

    def transform(self, xs: str, v: str, to: str) -> str:
        return f"list_transform({xs}, lambda {v}: {to})"

    def fold(self, xs: str, a: str, x: str, step: str) -> str:
        return f"list_reduce(list_concat([''], {xs}), lambda {a}, {x}: {step})"

    def let(self, name: str, value: str, body: str) -> str:
        return f"list_transform([{value}], lambda {name}: {body})[1]"

    def decoded(self, x: str) -> str:
        return f"url_decode(replace({x}, '+', ' '))"

    def encoded(self, x: str) -> str:
        return f"replace(replace(replace(url_encode({x}), '%20', '+'), '%2A', '*'), '~', '%7E')"

    def size(self, xs: str) -> str:
        return f"CAST(len({xs}) AS BIGINT)"

    def join(self, xs: str, sep: str) -> str:
        return f"array_to_string({xs}, {self.lit(sep)})"

    def split(self, x: str, sep: str) -> str:
        return f"string_split({x}, {self.lit(sep)})"

    def at(self, xs: str, i: str | int) -> str:
        return f"({xs})[{i}]"

    def distinct(self, xs: str) -> str:
        return f"list_filter({xs}, lambda v, i: list_position({xs}, v) = i)"

    def starts(self, x: str, y: str) -> str:
        return f"starts_with({x}, {y})"

    def ends(self, x: str, y: str) -> str:
        return f"ends_with({x}, {y})"

    def octets(self, x: str) -> str:
        return f"CAST(strlen({x}) AS BIGINT)"

    def explode(self, base: str, columns: str, xs: str, name: str = "x") -> str:
        return f"SELECT {columns}, CAST(pos_ AS BIGINT) - 1 AS pos, {name} FROM (SELECT *, unnest(l_) AS {name}, generate_subscripts(l_, 1) AS pos_ FROM (SELECT *, {xs} AS l_ FROM ({base})))"

    def once(self, base: str, columns: str, expression: str, name: str) -> str:
        return f"SELECT {columns}, {expression} AS {name} FROM ({base})"

    def micros(self, ts: str) -> str:
        return f"epoch_us({ts})"

    def ordered(self, x: str, sep: str, by: str) -> str:
        return f"string_agg(CAST({x} AS VARCHAR), {self.lit(sep)} ORDER BY {by}, CAST({x} AS VARCHAR))"

    def json_text(self, x: str, key: str) -> str:
        return f"json_extract_string({x}, '$.{key}')"


SPARK, DUCK = Spark(), Duck()
