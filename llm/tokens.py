"""Token counts by remembered units and chunk state maps.

No transducer over bytes is built (the README says so). White space always returns the tokenizer to its start state, and
between two white spaces it reads one unit. The number of tokens of a unit is worked out when first met (normalization,
splitting, then pair merging) and kept.

A text is read in chunks of equal length. What a chunk does to any state the transducer can be in is its state map:
how many tokens its inner units emit, the text before its first white space, which completes the unit left open by
whatever comes before, and the text after its last one, which stays open. Maps compose associatively, so a scan over
chunks, in any grouping, gives the text's count.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Unicode White_Space, as in the tokenizer's own pattern.
SPACE = "\t-\r \x85\xa0  -     　"
_UNIT = re.compile(f"[^{SPACE}]+")
_GAP = re.compile(f"[{SPACE}]")
CHUNK = 1 << 16
LIMIT = 2048
_ARCS, _LONG = 1 << 20, 64  # arcs kept, and the longest unit that is kept

# Where the library's Unicode tables differ from those of Python and its regex module.
#: Lower cases of Unicode 16 and 17.
_NEW_LOWER = {
    0x1C89: 0x1C8A, 0xA7CB: 0x0264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x019B,
    **{c: c + 0x20 for c in range(0x10D50, 0x10D66)},
    **{c: c + 0x1B for c in range(0x16EA0, 0x16EB9)},
}
#: Code points that the library takes for no letters.
_NO_LETTERS = "".join(chr(p + c) for p in (0x32000, 0x3D000, 0x3E000, 0x3F000) for c in (0x808, 0x85C, 0x988))
_ODD = re.compile(f"[{_NO_LETTERS}]")


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 stands for itself, the
    others follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Transducer:
    """Counts the tokens of texts for a byte-level pair-merging vocabulary with word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, norm, pre = spec["model"], spec["normalizer"], spec["pre_tokenizer"]
        steps = [n["type"] for n in norm["normalizers"]] if norm and norm["type"] == "Sequence" else []
        split = pre["pretokenizers"][0] if pre and pre["type"] == "Sequence" else {}
        if (
            model["type"] != "BPE" or model["dropout"] or model["ignore_merges"] or model["continuing_subword_prefix"]
            or steps != ["NFC", "Replace", "Lowercase"] or norm["normalizers"][1]["pattern"] != {"Regex": r"\s+"}
            or split.get("type") != "Split" or not split["invert"] or split["behavior"] != "Removed"
            or any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"])
        ):
            raise ValueError(f"{path}: not a tokenizer this transducer can be compiled from")
        self.end = model["end_of_word_suffix"] or ""
        merges = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.rank = {(a, b): i for i, (a, b) in enumerate(merges)}
        self.letters = _byte_letters()
        pattern = split["pattern"]["Regex"]
        self.piece = regex.compile(pattern)
        letter = rf"[\p{{L}}--[{_NO_LETTERS}]]"
        self.odd_piece = regex.compile(pattern.replace(r"\p{L}", letter), regex.V1)
        special = sorted((re.escape(t["content"]) for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(special) or r"(?!)")
        self.arcs: dict[str, int] = {}
        self.pieces: dict[str, int] = {}

    def merged(self, piece: str) -> int:
        """Tokens of one piece: the adjacent pair of lowest rank merges first, the leftmost among equals."""
        part = [self.letters[b] for b in piece.encode("utf-8")]
        part[-1] += self.end
        n, rank = len(part), self.rank
        after, before, gone = list(range(1, n + 1)), list(range(-1, n - 1)), [False] * n
        queue = [(r, i, part[i], part[i + 1]) for i in range(n - 1) if (r := rank.get((part[i], part[i + 1]))) is not None]
        heapq.heapify(queue)
        count = n
        while queue:
            _, i, a, b = heapq.heappop(queue)
            j = after[i]
            if gone[i] or j >= n or part[i] != a or part[j] != b:
                continue
            part[i], gone[j], after[i] = a + b, True, after[j]
            count -= 1
            if after[i] < n:
                before[after[i]] = i
                if (r := rank.get((part[i], part[after[i]]))) is not None:
                    heapq.heappush(queue, (r, i, part[i], part[after[i]]))
            if (k := before[i]) >= 0 and (r := rank.get((part[k], part[i]))) is not None:
                heapq.heappush(queue, (r, k, part[k], part[i]))
        return count

    def _compile(self, unit: str) -> int:
        total, at = 0, 0
        for m in self.special.finditer(unit):
            total += 1 + self._plain(unit[at : m.start()])
            at = m.end()
        return total + self._plain(unit[at:])

    def _plain(self, text: str) -> int:
        total = 0
        pattern = self.piece
        if text.isascii():
            text = text.lower()
        else:
            text = "".join(c.lower() for c in unicodedata.normalize("NFC", text).translate(_NEW_LOWER))
            pattern = self.odd_piece if _ODD.search(text) else pattern
        for piece in pattern.findall(text):
            n = self.pieces.get(piece)
            if n is None:
                n = self.merged(piece)
                if len(piece) <= _LONG:
                    if len(self.pieces) >= _ARCS // 2:
                        self.pieces.clear()
                    self.pieces[piece] = n
            total += n
        return total

    def arc(self, unit: str) -> int:
        """Tokens that reading one unit from the start state emits."""
        n = self.arcs.get(unit)
        if n is None:
            n = self._compile(unit)
            if len(unit) <= _LONG:
                if len(self.arcs) >= _ARCS:
                    self.arcs.clear()
                self.arcs[unit] = n
        return n

    def state_map(self, chunk: str) -> tuple[bool, str, int, str]:
        """(whether white space resets the state, open head, tokens emitted between, open tail)."""
        first = _GAP.search(chunk)
        if not first:
            return False, chunk, 0, ""
        last = len(chunk)
        while not _GAP.match(chunk, last - 1):
            last -= 1
        arcs, total = self.arcs, 0
        for unit in _UNIT.findall(chunk, first.start(), last):
            n = arcs.get(unit)
            total += self.arc(unit) if n is None else n
        return True, chunk[: first.start()], total, chunk[last:]

    def compose(self, a: tuple, b: tuple) -> tuple:
        """The map of a chunk followed by another one. Texts without a reset only grow longer."""
        if not a[0]:
            return (b[0], a[1] + b[1], b[2], b[3])
        if not b[0]:
            return (True, a[1], a[2], a[3] + b[1])
        between = a[3] + b[1]
        return (True, a[1], a[2] + b[2] + (self.arc(between) if between else 0), b[3])

    def count(self, text: str, chunk: int = CHUNK) -> int:
        maps = [self.state_map(text[i : i + chunk]) for i in range(0, len(text), chunk)] or [(False, "", 0, "")]
        while len(maps) > 1:  # a balanced scan
            pairs = [self.compose(maps[i], maps[i + 1]) for i in range(0, len(maps) - 1, 2)]
            maps = pairs + maps[len(pairs) * 2 :]
        _, head, total, tail = maps[0]
        return total + sum(self.arc(x) for x in (head, tail) if x)


_compiled: dict[str, Transducer] = {}


def compiled(path: str) -> Transducer:
    """One transducer per process and file; its arcs serve all later tasks."""
    if path not in _compiled:
        _compiled[path] = Transducer(path)
    return _compiled[path]


def token_counts(df: DataFrame, path: str, limit: int = LIMIT, drop: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with n_bytes, n_tokens and over_limit (more than ``limit`` tokens), one row per row.

    ``path`` is a tokenizer file that every executor can open. NULL and empty texts have 0 tokens. Texts are read
    whole. Columns of those three names are replaced, others stay except those named in ``drop``; an empty table
    gives an empty result.
    """
    cols = [c for c in df.columns if c not in ("n_bytes", "n_tokens", "over_limit")]
    plain = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(cols)])
    at, kept = cols.index("text"), [i for i, c in enumerate(cols) if c not in drop]

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = compiled(path)
        for b in batches:
            texts = [t.as_py() or "" for t in b.column(at)]
            size = pa.array([len(t.encode("utf-8")) for t in texts], pa.int64())
            n = pa.array([machine.count(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in kept), size, n], names=[*(f"c{i}" for i in kept), "n_bytes", "n_tokens"])

    types = {f.name: f.dataType.simpleString() for f in df.schema}
    out = plain.mapInArrow(counted, ", ".join([*(f"c{i} {types[cols[i]]}" for i in kept), "n_bytes long", "n_tokens long"]))
    return out.select(*[F.col(f"c{i}").alias(cols[i]) for i in kept], "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
