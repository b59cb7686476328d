"""URL filter: all wildcard rules simulated at once by a bit-parallel automaton.

Every rule is a glob over the canonical url "." + host + path. ``*`` stands for any
run without a slash, ``**`` for any run, every other character for itself. All
globs are packed one after another into the bits of as many 64-bit words as they need
(Shift-And): one shift, whose carry goes on to the next word, and two masks per
character advance every rule, and numpy does this for many urls together. A host rule ``example.com/de/`` is the glob ``**.example.com/de/**``
anchored at the host: it fits the host and all subdomains.

Defined cases: null url or one without ``://`` has empty host and path, fits no
rule and is allowed; an empty table gives an empty result; repeated rows repeat;
extra columns are ignored; very long urls take steps in proportion to their length, and
urls are taken together only up to a bound of their characters.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import lower_ascii

WORD = 64

# The host and path rules, then the globs that block what no rule decides.
HOST_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
BLOCK_GLOBS = [
    "*.ads.**",
    "*.adserver.**",
    "*.doubleclick.**",
    "**/ads/**",
    "**/banner/**",
    "**/doorway/**",
    "**.exe",
    "*.spam-*/**",
    "*.spam.*/**",
    "*casino*/**",
    "*porn*/**",
    "*-xxx*/**",
]


def host_glob(rule: str) -> str:
    """The glob of a host and path rule."""
    host, slash, path = rule.partition("/")
    return f"*.{host}{slash}{path}**"


def parse(glob: str) -> list[str]:
    """Items of a glob: ``**``, ``*`` and single characters."""
    items, i = [], 0
    while i < len(glob):
        step = 2 if glob.startswith("**", i) else 1
        items.append(glob[i : i + step])
        i += step
    return items


@dataclass(frozen=True)
class Automaton:
    """Masks of all rules. Bit b of a rule means: its first items up to b are matched."""

    start: np.ndarray  # state before the first character
    shift_in: dict[str, np.ndarray]  # character -> positions that it may enter
    other: np.ndarray  # the same for a character that no rule has
    any_run: np.ndarray  # positions after ``**``
    name_run: np.ndarray  # positions after ``*``
    accept: list[tuple[int, np.uint64]]  # word and bit of each rule's end

    @staticmethod
    def of(globs: Sequence[str]) -> Automaton:
        """Pack the globs bit by bit; a rule may begin in one word and end in another."""
        parsed = [parse(g) for g in globs]
        words = -(-sum(len(items) + 1 for items in parsed) // WORD) or 1
        zero = lambda: np.zeros(words, np.uint64)
        enter = {c: zero() for c in sorted({x for items in parsed for x in items if len(x) == 1 and x != "*"})}
        start, any_run, name_run, accept, used = zero(), zero(), zero(), [], 0
        bit = lambda at: (at // WORD, np.uint64(1 << at % WORD))
        for items in parsed:
            for at, item in enumerate([None, *items], used):
                mask = start if item is None else any_run if item == "**" else name_run if item == "*" else enter[item]
                word, own = bit(at)
                mask[word] |= own
            used += len(items) + 1
            accept.append(bit(used - 1))
        return Automaton(start, enter, zero(), any_run, name_run, accept)

    def shifted(self, state: np.ndarray) -> np.ndarray:
        """Every bit one place on, from word to word. A rule's last bit moves to the next rule's start, which no mask lets in."""
        out = state << np.uint64(1)
        out[:, 1:] |= state[:, :-1] >> np.uint64(WORD - 1)
        return out

    def closed(self, state: np.ndarray) -> np.ndarray:
        """Wildcards also match nothing: enter them without a character."""
        runs = self.any_run | self.name_run
        while True:
            more = state | (self.shifted(state) & runs)
            if (more == state).all():
                return state
            state = more

    def matches(self, texts: Sequence[str], most_chars: int = 1 << 22) -> np.ndarray:
        """Boolean matrix: text x rule. Texts of like length go together, about ``most_chars`` characters at a time."""
        order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
        found = np.zeros((len(texts), len(self.accept)), bool)
        at = 0
        while at < len(order):
            own = order[at : at + max(1, most_chars // max(1, len(texts[order[at]])))]
            found[own] = self._matches([texts[i] for i in own])
            at += len(own)
        return found

    def _matches(self, texts: list[str]) -> np.ndarray:
        """The same for texts ordered by length, longest first, laid out as one table."""
        lengths = np.array([len(t) for t in texts], np.int64)
        state = np.repeat(self.closed(self.start[None, :]), len(texts), axis=0)
        codes = {c: k for k, c in enumerate(self.shift_in, 1)}
        enter = np.stack([self.other, *self.shift_in.values()])
        # A slash ends runs of ``*``; a run of ``**`` goes on with any character.
        stay = np.stack([self.any_run | self.name_run, *[self.any_run if c == "/" else self.any_run | self.name_run for c in self.shift_in]])
        if "/" not in codes:
            codes["/"] = len(enter)
            enter, stay = np.vstack([enter, self.other]), np.vstack([stay, self.any_run])
        table = np.zeros((len(texts), int(lengths[0])), np.int16)
        for row, text in enumerate(texts):
            table[row, : len(text)] = [codes.get(c, 0) for c in text]
        for at in range(table.shape[1]):
            n = int(np.searchsorted(-lengths, -at, side="left"))  # texts longer than `at`
            own, code = state[:n], table[:n, at]
            state[:n] = self.closed((self.shifted(own) & enter[code]) | (own & stay[code]))
        return np.stack([(state[:, word] & bit) != 0 for word, bit in self.accept], axis=1) if self.accept else np.zeros((len(texts), 0), bool)


def split_url(url):
    """Columns host (A-Z lower-cased) and path of a url column; empty without ``://``."""
    has = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    rest = F.expr("substring(url, instr(url, '://') + 3)")
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.when(has, lower_ascii(host)).otherwise(F.lit("")), F.when(has, path).otherwise(F.lit(""))


def judge(pages: DataFrame, host_rules: Sequence[tuple[str, str]] = HOST_RULES, block_globs: Sequence[str] = BLOCK_GLOBS, rows_at_once: int = 1024) -> DataFrame:
    """Per page: page_id, host, path, rule (longest that fits, or null), verdict, glob_hits."""
    automaton = Automaton.of([*map(host_glob, (r for r, _ in host_rules)), *block_globs])
    longest = sorted(range(len(host_rules)), key=lambda i: len(host_rules[i][0]))
    n_rules = len(host_rules)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(i, rows_at_once) for i in range(0, len(whole), rows_at_once)):
                hosts, paths = batch.column(1).to_pylist(), batch.column(2).to_pylist()
                found = automaton.matches([f".{h}{p}" if h or p else "" for h, p in zip(hosts, paths, strict=True)])
                hits = found[:, n_rules:].sum(axis=1)
                rules: list[str | None] = [None] * len(batch)
                verdicts = np.where(hits > 0, "block", "allow").tolist()
                for i in longest:
                    for row in np.flatnonzero(found[:, i]):
                        rules[row], verdicts[row] = host_rules[i]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), batch.column(2), pa.array(rules, pa.string()), pa.array(verdicts, pa.string()), pa.array(hits, pa.int64())],
                    names=["page_id", "host", "path", "rule", "verdict", "glob_hits"],
                )

    host, path = split_url(F.col("url"))
    urls = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")).select("page_id", host.alias("host"), path.alias("path"))
    return urls.mapInArrow(rows, "page_id long, host string, path string, rule string, verdict string, glob_hits long")
