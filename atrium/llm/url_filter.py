"""Operator 6: URL filters by a bit-parallel wildcard automaton."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Code point of the border between host and path; outside Unicode, so no URL has it.
BORDER = 0x110000
STAR = -1


@dataclass(frozen=True)
class Rule:
    """A rule of the list: it fits a host and its subdomains, and paths that start with its own."""

    verdict: str
    host: str
    path: str

    def glob(self) -> list[int]:
        return [STAR, ord("."), *map(ord, self.host), BORDER, *map(ord, self.path), STAR]


def glob(pattern: str) -> list[int]:
    """A glob over ``host`` + ``path``; * stands for any characters, ^ for the border between the two."""
    return [STAR if c == "*" else BORDER if c == "^" else ord(c) for c in pattern]


#: Blocked where no rule of the list fits: kinds of hosts, as globs.
SPAM = ("*pills*^*", "*casino*^*", "*viagra*^*", "*.xxx^*", "*porn*^*", "*betting*^*", "*free-download*^*", "*^*/wp-login*", "*^*/cgi-bin/*")


@dataclass
class Automaton:
    """Masks of all patterns, packed in words of 64 bits.

    Bit i of the state says that a pattern has matched up to its i-th character.
    A star keeps its bit set, and passes it on without a character.
    """

    masks: np.ndarray
    symbols: np.ndarray
    stay: np.ndarray
    begin: np.ndarray
    skip: np.ndarray
    final: list[int]

    @classmethod
    def of(cls, patterns: list[list[int]]) -> Automaton:
        symbols = np.unique([c for p in patterns for c in p if c != STAR]).astype(np.int64)
        total = sum(len(p) + 1 for p in patterns)
        width = max(1, -(-total // 64))
        masks = np.zeros((len(symbols) + 1, width), np.uint64)  # the last row: all other characters
        stay, begin, skip = (np.zeros(width, np.uint64) for _ in range(3))
        final, at = [], 0
        on = lambda mask, i: mask.__setitem__(i // 64, mask[i // 64] | np.uint64(1) << np.uint64(i % 64))
        for p in patterns:
            on(begin, at)  # before the first character
            for k, c in enumerate(p):
                i = at + k + 1  # the bit after character k
                if c == STAR:
                    on(skip, i)
                    on(stay, i)
                else:
                    on(masks[np.searchsorted(symbols, c)], i)
            final.append(at + len(p))
            at += len(p) + 1
        return cls(masks, symbols, stay, begin, skip, final)

    @staticmethod
    def _shift(d: np.ndarray) -> np.ndarray:
        out = d << np.uint64(1)
        out[:, 1:] |= d[:, :-1] >> np.uint64(63)
        return out

    def _close(self, d: np.ndarray) -> np.ndarray:
        """A star's bit is set as soon as the bit before it is (stars in a row need several steps)."""
        while True:
            more = self._shift(d) & self.skip & ~d
            if not more.any():
                return d
            d = d | more

    def run(self, codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Which patterns match each whole string: booleans (strings, patterns)."""
        n = len(lengths)
        d = self._close(np.repeat(self.begin[None, :], n, axis=0))
        first = np.cumsum(lengths) - lengths
        live = np.arange(n)
        order = np.searchsorted(self.symbols, codes)
        order = np.where((order < len(self.symbols)) & (self.symbols[np.minimum(order, len(self.symbols) - 1)] == codes), order, len(self.symbols)) if len(self.symbols) else np.zeros(len(codes), np.int64)
        for j in range(int(lengths.max(initial=0))):
            live = live[lengths[live] > j]
            now = d[live]
            d[live] = self._close((self._shift(now) & self.masks[order[first[live] + j]]) | (now & self.stay))
        return np.stack([(d[:, i // 64] >> np.uint64(i % 64) & np.uint64(1)).astype(bool) for i in self.final], axis=1) if self.final else np.zeros((n, 0), bool)


def split_url(url_col: str = "url"):
    """Columns host and path: the host after the first ``://`` up to / ? # or the end, A-Z lower-cased;
    the path then up to ? or #. Null or no ``://``: both empty."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, F.expr(f"substring(coalesce(`{url_col}`, ''), instr(coalesce(`{url_col}`, ''), '://') + 3)")).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return host, path


def filter_urls(pages: DataFrame, rules: list[Rule], spam: tuple[str, ...] = SPAM, url_col: str = "url", id_col: str = "page_id") -> DataFrame:
    """(id, host, path, rule, verdict, pattern) for every row.

    All rules and globs are bits of one multiword Shift-And automaton that reads
    each canonical URL once. Of the rules that fit, the one with the longest host
    and path gives the verdict (of equally long ones the first listed). Without a
    fitting rule the first fitting glob blocks; otherwise the URL is allowed.
    ``pattern`` names that glob.

    Rows with a null URL or one without ``://`` have an empty host and path, which
    no rule fits, and are allowed. Rows with repeated or null ids stay as they
    are. Other columns are ignored.
    """
    host, path = split_url(url_col)
    by_length = sorted(rules, key=lambda r: -len(r.host + r.path))
    automaton = pages.sparkSession.sparkContext.broadcast(Automaton.of([r.glob() for r in by_length] + [glob(g) for g in spam]))
    names = [r.host + r.path for r in by_length]
    verdicts = [r.verdict for r in by_length]

    def run(batches):
        machine = automaton.value
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                texts = [[0x2E, *map(ord, h), BORDER, *map(ord, p)] for h, p in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)]
                lengths = np.array([len(t) for t in texts], np.int64)
                codes = np.fromiter((c for t in texts for c in t), np.int64, int(lengths.sum()))
                # A canonical URL starts with a dot, so *.host fits the host itself; a glob sees it too.
                hit = machine.run(codes, lengths)
                fits, bad = hit[:, : len(names)], hit[:, len(names) :]
                best = np.where(fits.any(axis=1), fits.argmax(axis=1), -1) if names else np.full(len(texts), -1)
                worst = np.where(bad.any(axis=1), bad.argmax(axis=1), -1) if spam else np.full(len(texts), -1)
                rule = [names[i] if i >= 0 else None for i in best]
                verdict = [verdicts[i] if i >= 0 else "block" if w >= 0 else "allow" for i, w in zip(best, worst, strict=True)]
                pattern = [spam[w] if i < 0 and w >= 0 else None for i, w in zip(best, worst, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(rule, pa.string()), pa.array(verdict, pa.string()), pa.array(pattern, pa.string())], [id_col, "host", "path", "rule", "verdict", "pattern"])

    kind = dict(pages.dtypes)[id_col]
    return pages.select(F.col(id_col), host.alias("host"), path.alias("path")).mapInArrow(run, f"`{id_col}` {kind}, host string, path string, rule string, verdict string, pattern string")
