"""URL filters: pattern rules indexed by their rarest literal token.

A rule is ``host/path`` with an action. It fits its host and all subdomains when the url's path starts
with the rule's path; ``*`` in a path stands for any run of characters. Each rule is filed under one of its
literal tokens (host labels and whole path segments), the one that the fewest rules share. The tokens
of a url fetch candidate rules, and only those run their regular expressions. The longest fitting rule wins; between
equally long ones the one that comes first in the list.

Defined cases: a null url, or one without ``://``, has an empty host and path, fits no rule and gets the default verdict;
an empty rule list gives every url the default verdict; repeated rows are judged one by one; other columns are kept,
and a column named like a result column is replaced.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import letters_lower, widened

URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
MAX_INDEX_BYTES = 256 << 20
#: Most urls of a corpus share few host and path shapes; so many answers are remembered in a task.
REMEMBERED = 50_000


@dataclass(frozen=True)
class Rule:
    text: str
    action: str

    def __post_init__(self) -> None:
        if "/" not in self.text or not self.host.strip(".") or self.action not in ("allow", "block"):
            raise ValueError(f"not a rule: {self.action} {self.text}")

    @property
    def host(self) -> str:
        """With A-Z as a-z, as hosts of urls are compared."""
        return "".join(c.lower() if c.isascii() else c for c in self.text.partition("/")[0])

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2]

    def tokens(self) -> list[str]:
        """Literal tokens that every fitting url has: host labels, and path segments that the rule closes."""
        closed = self.path.split("/")[1:-1]
        return [f"h:{x}" for x in self.host.split(".") if x] + [f"p:{x}" for x in closed if x and "*" not in x]

    def pattern(self) -> str:
        return rf"(?s)(?:.*\.)?{re.escape(self.host)}\x00" + ".*".join(map(re.escape, self.path.split("*")))


class RuleIndex:
    def __init__(self, rules: list[Rule]):
        shared = Counter(t for r in rules for t in set(r.tokens()))
        self.rules = list(rules)
        self.by_token: dict[str, list[int]] = defaultdict(list)
        for i, rule in enumerate(rules):
            token = min(rule.tokens(), key=lambda t: (shared[t], -len(t), t))
            self.by_token[token].append(i)
        self.compiled: dict[int, re.Pattern] = {}

    def __getstate__(self) -> dict:
        return {**self.__dict__, "compiled": {}}

    def find(self, host: str, path: str) -> Rule | None:
        seen = {f"h:{x}" for x in host.split(".")} | {f"p:{x}" for x in path.split("/")}
        best = None
        for i in {i for t in seen for i in self.by_token.get(t, ())}:
            rule = self.rules[i]
            if i not in self.compiled:
                self.compiled[i] = re.compile(rule.pattern())
            if self.compiled[i].match(f"{host}\x00{path}") and (best is None or (-len(rule.text), i) < best[0]):
                best = ((-len(rule.text), i), rule)
        return best and best[1]


def url_filter(df: DataFrame, rules: list[Rule], url: str = "url", default: str = "allow") -> DataFrame:
    """df with host, path, rule and verdict. The rules' text may take MAX_INDEX_BYTES at most, as every executor holds the index."""
    if sum(len(r.text) for r in rules) * 8 > MAX_INDEX_BYTES:
        raise ValueError("the rules are too large to be held by every executor")
    index = df.sparkSession.sparkContext.broadcast(RuleIndex(rules))
    u = F.coalesce(F.col(f"`{url}`"), F.lit(""))
    parsed = df.withColumns({"host": letters_lower(F.regexp_extract(u, URL, 1)), "path": F.regexp_extract(u, URL, 2)}).drop("rule", "verdict")
    schema = widened(parsed, rule="string", verdict="string")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[str, str], Rule | None] = {}
        for batch in batches:
            found = []
            for key in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True):
                if key not in known:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[key] = index.value.find(*key)
                found.append(known[key])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([r and r.text for r in found], pa.string()), pa.array([r.action if r else default for r in found], pa.string())],
                names=[*batch.schema.names, "rule", "verdict"],
            )

    return parsed.mapInArrow(judge, schema)
