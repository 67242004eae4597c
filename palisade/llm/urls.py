"""URL filters: all glob rules at once by a bit-parallel wildcard automaton.

Rules are globs over the canonical URL (host in lower case, then the path), ``*`` standing for any run of characters. The
literal characters of all rules are laid side by side in one multiword mask, a bit each. Reading a character moves every
rule on at once: state = ((state << 1) | starts) & mask[character], and a bit in front of a ``*`` stays set once reached.
A column of URLs is read in step, numpy holding one state of a few words for each of them.

Host and path are held apart by a byte that no UTF-8 text contains, so a host's ``*`` cannot run into the path.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from palisade.llm.common import narrow

#: Between host and path.
SEAM = 0xFF
#: URLs read in step.
STRIP = 4096


@dataclass(frozen=True)
class SiteRule:
    """Fits ``host`` and its subdomains where the path starts with ``path``; of several that fit the longest decides."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules of the contract, and the globs that judge what no rule fits.
SITE_RULES = (
    SiteRule("allow", "com", "/"), SiteRule("block", "example.com", "/en/"), SiteRule("allow", "www.example.com", "/en/"),
    SiteRule("block", "net", "/es/"), SiteRule("block", "net", "/fr/"),
)
BLOCK_GLOBS = (
    "*casino*", "*poker*", "*free-bets*", "*betting*", "*viagra*", "*porn*", "*xxx*", "*adult-*", "*/ads/*", "*/tracker/*",
    "*/wp-login*", "*/*.exe", "*/*.zip", "*/cgi-bin/*",
)


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path; both empty for a null or a text without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring({u}, instr({u}, '://') + 3)".replace("{u}", "_url"))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


class Automaton:
    """Shift-And over many globs (bytes). ``matches`` tells for each text which globs fit it as a whole."""

    def __init__(self, globs: Sequence[bytes]):
        # A bit for the state before each glob's first character and one for each literal character.
        sizes = [len(g.replace(b"*", b"")) + 1 for g in globs]
        total = sum(sizes)
        self.words = max(1, -(-total // 64))
        masks = np.zeros((256, self.words * 64), np.uint8)
        begin, stay = np.zeros(self.words * 64, np.uint8), np.zeros(self.words * 64, np.uint8)
        self.final = np.zeros(len(globs), np.int64)
        at = 0
        for i, glob in enumerate(globs):
            begin[at] = 1
            for byte in glob:
                if byte == ord("*"):
                    stay[at] = 1
                else:
                    at += 1
                    masks[byte, at] = 1
            self.final[i] = at
            at += 1
        self.masks, self.begin, self.stay = (np.packbits(x, axis=-1, bitorder="little").view(np.uint64) for x in (masks, begin, stay))

    def matches(self, texts: Sequence[bytes]) -> np.ndarray:
        """Boolean matrix: texts by globs."""
        out = np.zeros((len(texts), len(self.final)), bool)
        order = np.argsort([len(t) for t in texts], kind="stable")
        for lo in range(0, len(texts), STRIP):
            out[order[lo : lo + STRIP]] = self._strip([texts[i] for i in order[lo : lo + STRIP]])
        return out

    def _strip(self, texts: list[bytes]) -> np.ndarray:
        lengths = np.array([len(t) for t in texts])  # in rising order
        offsets = np.cumsum(lengths) - lengths
        data = np.frombuffer(b"".join(texts), np.uint8)
        state = np.tile(self.begin, (len(texts), 1))
        for step in range(int(lengths[-1]) if len(lengths) else 0):
            live = np.searchsorted(lengths, step, side="right")
            now = state[live:]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            # The bit before a glob is never entered from its neighbour: no character's mask has it.
            state[live:] = moved & self.masks[data[offsets[live:] + step]] | now & self.stay
        return (state[:, self.final >> 6] >> (self.final & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


def _glob(host: str, path: str) -> list[bytes]:
    seam = bytes([SEAM])
    tail = seam + path.encode() + b"*"
    return [host.encode() + tail, b"*." + host.encode() + tail]


def judge(rules: Sequence[SiteRule], block: Sequence[str]):
    """``host, path`` columns to ``rule, verdict``."""
    site = [g for r in rules for g in _glob(r.host, r.path)]
    longest = sorted(range(len(rules)), key=lambda i: len(rules[i].name), reverse=True)
    # Site rules read host, seam, path; the block globs read the URL as one text.
    by_site, by_glob = Automaton(site), Automaton([g.encode() for g in block])

    @pandas_udf("rule string, verdict string")
    def judged(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for hosts, paths in batches:
            pairs = [(h.encode("utf-8", "surrogatepass"), p.encode("utf-8", "surrogatepass")) for h, p in zip(hosts, paths)]
            fits = by_site.matches([h + bytes([SEAM]) + p for h, p in pairs])
            fits = fits[:, 0::2] | fits[:, 1::2]
            bad = by_glob.matches([h + p for h, p in pairs]).any(axis=1) if block else np.zeros(len(pairs), bool)
            rule = np.full(len(pairs), -1)
            for i in reversed(longest):
                rule[fits[:, i]] = i
            yield pd.DataFrame({
                "rule": [rules[i].name if i >= 0 else None for i in rule.tolist()],
                "verdict": [rules[i].verdict if i >= 0 else "block" if b else "allow" for i, b in zip(rule.tolist(), bad.tolist())],
            })

    return judged


def judge_urls(pages: DataFrame, rules: Sequence[SiteRule] = SITE_RULES, block: Sequence[str] = BLOCK_GLOBS,
               page_id: str = "page_id", url: str = "url") -> DataFrame:
    """One row per input row: ``page_id, host, path, rule, verdict``.

    ``rule`` is the longest rule that fits (of equal length: the earlier one), else null, and ``verdict`` is its verdict;
    without a rule a URL is blocked if one of the globs fits it, else allowed. A null URL and one without ``://`` have an
    empty host and path, which no rule and none of the given globs fits. Repeated rows stay, a null page_id is passed on, an empty table gives an
    empty result, other columns are not looked at. A ``*`` written in a URL is an ordinary character.
    """
    rows = narrow(pages, page_id=page_id, _url=url)
    host, path = parts(F.col("_url"))
    split = rows.select("page_id", host.alias("host"), path.alias("path"))
    return split.withColumn("found", judge(rules, block)("host", "path")).select("page_id", "host", "path", "found.rule", "found.verdict")
