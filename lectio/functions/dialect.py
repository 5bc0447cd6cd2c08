"""SQL text for Spark or, for the oracle, DuckDB: where the two differ, a function here says how."""

from __future__ import annotations


class Dialect:
    def __init__(self, duck: bool, prefix: str = "") -> None:
        self.duck, self.prefix = duck, prefix

    def table(self, name: str) -> str:
        return name if self.duck else f"{self.prefix}{name}"

    def text(self, s: str) -> str:
        """A literal, backslashes as they are; no quotes inside."""
        return f"'{s}'" if self.duck else f"r'{s}'"

    def hit(self, c: str, pattern: str) -> str:
        """Whether a pattern is found in c."""
        return f"regexp_matches({c}, {self.text(pattern)})" if self.duck else f"({c} RLIKE {self.text(pattern)})"

    def count(self, c: str, pattern: str) -> str:
        return f"CAST(len(regexp_extract_all({c}, {self.text(pattern)})) AS INT)" if self.duck else f"regexp_count({c}, {self.text(pattern)})"

    def replace(self, c: str, pattern: str, new: str) -> str:
        """All matches replaced; new has no group references."""
        return f"regexp_replace({c}, {self.text(pattern)}, {self.text(new)}" + (", 'g')" if self.duck else ")")

    def extract(self, c: str, pattern: str, group: int = 1) -> str:
        """The group of the first match, or an empty string."""
        return f"regexp_extract({c}, {self.text(pattern)}, {group})"

    def extract_all(self, c: str, pattern: str, group: int = 1) -> str:
        return f"regexp_extract_all({c}, {self.text(pattern)}, {group})"

    def split(self, c: str, pattern: str) -> str:
        return f"string_split_regex({c}, {self.text(pattern)})" if self.duck else f"split({c}, {self.text(pattern)}, -1)"

    def filter(self, a: str, x: str, condition: str) -> str:
        return f"list_filter({a}, lambda {x}: {condition})" if self.duck else f"filter({a}, {x} -> {condition})"

    def map(self, a: str, x: str, value: str) -> str:
        return f"list_transform({a}, lambda {x}: {value})" if self.duck else f"transform({a}, {x} -> {value})"

    def size(self, a: str) -> str:
        return f"CAST(len({a}) AS INT)" if self.duck else f"size({a})"

    def join(self, a: str, by: str) -> str:
        return f"array_to_string({a}, '{by}')" if self.duck else f"array_join({a}, '{by}')"

    def distinct(self, a: str) -> str:
        return f"list_distinct({a})" if self.duck else f"array_distinct({a})"

    def at(self, a: str, i: int) -> str:
        """Element i from 1, or null."""
        return f"({a})[{i}]" if self.duck else f"try_element_at({a}, {i})"

    def micros(self, c: str) -> str:
        return f"epoch_us({c})" if self.duck else f"unix_micros(CAST({c} AS TIMESTAMP))"

    def median(self, a: str) -> str:
        """Median of an array of numbers, null if it is empty."""
        if self.duck:
            return f"list_median({a})"
        return f"(CASE WHEN size({a}) > 0 THEN (array_sort({a})[(size({a}) - 1) DIV 2] + array_sort({a})[size({a}) DIV 2]) / 2e0 END)"

    def explode(self, source: str, array: str, name: str) -> str:
        """FROM clause: each element of an array column of source, which has to be a table or an aliased query."""
        return f"{source}, unnest({array}) AS u_({name})" if self.duck else f"{source} LATERAL VIEW explode({array}) u_ AS {name}"

    def once(self, source: str, value: str, name: str) -> str:
        """The same with one further column, computed once a row: an optimizer that puts it where it is used could compute it for each element of a lambda."""
        return f"(SELECT *, {value} AS {name} FROM {source}) AS o_" if self.duck else f"{source} LATERAL VIEW explode(array({value})) o_ AS {name}"

    def posexplode(self, source: str, array: str, place: str, name: str) -> str:
        """The same with places from 0."""
        if self.duck:
            return f"(SELECT *, unnest({array}) AS {name}, CAST(generate_subscripts({array}, 1) - 1 AS INT) AS {place} FROM {source}) AS u_"
        return f"{source} LATERAL VIEW posexplode({array}) u_ AS {place}, {name}"

    def last_known(self, value: str, over: str) -> str:
        return f"last_value({value} IGNORE NULLS) OVER ({over})" if self.duck else f"last({value}, true) OVER ({over})"

    def fold(self, c: str) -> str:
        """Lower case without accents of Western European letters."""
        return f"translate(lower({c}), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy')"

    def total(self, a: str, x: str, value: str) -> str:
        """The sum of a value over an array, 0 if it is empty."""
        if self.duck:
            return f"coalesce(list_sum(list_transform({a}, lambda {x}: CAST({value} AS DOUBLE))), 0e0)"
        return f"aggregate({a}, 0e0, (s_, {x}) -> s_ + CAST({value} AS DOUBLE))"
