"""Boolean formulas over a text column.

A formula is plain data.  ``column`` turns it into a Column, ``spark`` into Spark SQL text (a whole
catalogue becomes one expression in one call), ``sql`` into ANSI SQL text for other engines.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, functions as F


def quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def spark_quote(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


class Test:
    def spark(self, text: str) -> str:
        raise NotImplementedError

    def column(self, text: Column) -> Column:
        raise NotImplementedError

    def sql(self, text: str) -> str:
        raise NotImplementedError

    def __and__(self, other: "Test") -> "Test":
        return All((self, other))

    def __or__(self, other: "Test") -> "Test":
        return Any((self, other))

    def __invert__(self) -> "Test":
        return Not(self)


@dataclass(frozen=True)
class Has(Test):
    """The text contains a token, literally and case-sensitively."""

    token: str

    def column(self, text):
        return F.contains(text, F.lit(self.token))

    def sql(self, text):
        return f"contains({text}, {quote(self.token)})"

    def spark(self, text):
        return f"contains({text}, {spark_quote(self.token)})"


@dataclass(frozen=True)
class Matches(Test):
    """The text matches a regular expression somewhere (syntax common to Java and RE2)."""

    pattern: str

    def column(self, text):
        return text.rlike(self.pattern)

    def sql(self, text):
        return f"regexp_matches({text}, {quote(self.pattern)})"

    def spark(self, text):
        return f"rlike({text}, {spark_quote(self.pattern)})"


@dataclass(frozen=True)
class Count(Test):
    """The token occurs at least ``n`` times."""

    token: str
    n: int

    def column(self, text):
        return F.length(text) - F.length(F.replace(text, F.lit(self.token), F.lit(""))) >= F.lit(self.n * len(self.token))

    def sql(self, text):
        return f"length({text}) - length(replace({text}, {quote(self.token)}, '')) >= {self.n * len(self.token)}"

    def spark(self, text):
        return f"length({text}) - length(replace({text}, {spark_quote(self.token)}, '')) >= {self.n * len(self.token)}"


@dataclass(frozen=True)
class AtLeast(Test):
    """At least ``n`` of the parts hold."""

    n: int
    parts: tuple[Test, ...]

    def column(self, text):
        return reduce(lambda a, b: a + b, [p.column(text).cast("int") for p in self.parts]) >= F.lit(self.n)

    def sql(self, text):
        return "(" + " + ".join(f"cast({p.sql(text)} as int)" for p in self.parts) + f") >= {self.n}"

    def spark(self, text):
        return "(" + " + ".join(f"cast({p.spark(text)} as int)" for p in self.parts) + f") >= {self.n}"


@dataclass(frozen=True)
class SomeLine(Test):
    """Some line that is no comment matches ``pattern``."""

    pattern: str
    comment: str = r"^\s*(//|/\*|\*)"

    def column(self, text):
        return F.exists(F.split(text, "\n"), lambda l: l.rlike(self.pattern) & ~l.rlike(self.comment))

    def sql(self, text):
        return (f"len(list_filter(string_split({text}, chr(10)), lambda l: regexp_matches(l, {quote(self.pattern)})"
                f" AND NOT regexp_matches(l, {quote(self.comment)}))) > 0")

    def spark(self, text):
        return (f"exists(split({text}, '\\n'), l -> rlike(l, {spark_quote(self.pattern)})"
                f" AND NOT rlike(l, {spark_quote(self.comment)}))")


@dataclass(frozen=True)
class All(Test):
    parts: tuple[Test, ...]

    def column(self, text):
        return reduce(lambda a, b: a & b, [p.column(text) for p in self.parts])

    def sql(self, text):
        return "(" + " AND ".join(p.sql(text) for p in self.parts) + ")"

    def spark(self, text):
        return "(" + " AND ".join(p.spark(text) for p in self.parts) + ")"


@dataclass(frozen=True)
class Any(Test):
    parts: tuple[Test, ...]

    def column(self, text):
        return reduce(lambda a, b: a | b, [p.column(text) for p in self.parts])

    def sql(self, text):
        return "(" + " OR ".join(p.sql(text) for p in self.parts) + ")"

    def spark(self, text):
        return "(" + " OR ".join(p.spark(text) for p in self.parts) + ")"


@dataclass(frozen=True)
class Not(Test):
    part: Test

    def column(self, text):
        return ~self.part.column(text)

    def sql(self, text):
        return f"(NOT {self.part.sql(text)})"

    def spark(self, text):
        return f"(NOT {self.part.spark(text)})"


@dataclass(frozen=True)
class On(Test):
    """Apply a test to one named column when a rule looks at several."""

    name: str
    part: Test

    def column(self, text):
        return self.part.column(text[self.name])

    def sql(self, text):
        return self.part.sql(text[self.name])

    def spark(self, text):
        return self.part.spark(text[self.name])


@dataclass(frozen=True)
class Equals(Test):
    value: object

    def column(self, text):
        return text == F.lit(self.value)

    def sql(self, text):
        return f"{text} = {quote(self.value) if isinstance(self.value, str) else str(self.value).lower()}"

    def spark(self, text):
        return f"{text} = {spark_quote(self.value) if isinstance(self.value, str) else str(self.value).lower()}"


@dataclass(frozen=True)
class OneOf(Test):
    values: tuple[str, ...]

    def column(self, text):
        return text.isin(*self.values)

    def sql(self, text):
        return f"{text} IN ({', '.join(quote(v) for v in self.values)})"

    def spark(self, text):
        return f"{text} IN ({', '.join(spark_quote(v) for v in self.values)})"


@dataclass(frozen=True)
class ListHas(Test):
    """An array column contains the value."""

    value: str

    def column(self, text):
        return F.array_contains(text, self.value)

    def sql(self, text):
        return f"list_contains({text}, {quote(self.value)})"

    def spark(self, text):
        return f"array_contains({text}, {spark_quote(self.value)})"


@dataclass(frozen=True)
class SizeAtMost(Test):
    n: int

    def column(self, text):
        return F.size(text) <= F.lit(self.n)

    def sql(self, text):
        return f"len({text}) <= {self.n}"

    def spark(self, text):
        return f"size({text}) <= {self.n}"


def any_of(*tokens: str) -> Test:
    return Any(tuple(Has(t) for t in tokens))


def all_of(*tokens: str) -> Test:
    return All(tuple(Has(t) for t in tokens))


def none_of(*tokens: str) -> Test:
    return Not(any_of(*tokens))


#: Guard shared by most rules: the text is not test code.
NOT_TEST = none_of("#[test]", "#[cfg(test)]")


def on(name: str, test: Test | str) -> Test:
    return On(name, Has(test) if isinstance(test, str) else test)


@dataclass(frozen=True)
class Rule:
    """A named formula with the facts a finding carries."""

    id: str
    vuln_type: str
    category: str
    severity: int
    cwe: str | None
    when: Test
    kinds: tuple[str, ...] = ("fn",)
    confidence: float | None = None
    note: str = ""
