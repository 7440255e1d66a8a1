"""Benchmark decontamination with a generalised suffix automaton of the normalised test items.

Words are the runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after lower-casing A-Z. The automaton
holds every word sequence of every item; a document's words are streamed through it, and the
length of the longest match that ends at each word is tracked. A window is ``window`` consecutive
words of an item (a shorter item is one window as a whole), so a window ends where the match is at
least that long. Matched spans are cut out of the text, or the document goes, by the limits given.

Items are held in blocks of about ``BLOCK_WORDS`` words, one automaton and one broadcast for each:
a benchmark of any size is a stated query set read against all rows in blocks. Documents are
never grouped or shuffled.

NULL and empty texts have no words; NULL items, or items without words, have no window; repeated
items match alike and each is named; repeated documents are judged each on its own.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from strandline.llm.common import col, free_names

WINDOW = 10
BLOCK_WORDS = 200_000
#: Bytes of words stay (A-Z in lower case), all others become blanks.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


class Automaton:
    """Suffix automaton of many word sequences; states are numbers, 0 is the start."""

    def __init__(self, items: list[tuple[int, str | None]], window: int):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.step: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        sequences = []
        for item, text in items:
            words = [self.vocab.setdefault(w, len(self.vocab)) for w in words_of(text)]
            if words:
                sequences.append((item, words))
                self._add(words)
        #: Items whose window ends in a state, and the length of that window.
        self.items: dict[int, set] = {}
        self.whole: dict[int, int] = {}
        for item, words in sequences:
            size = min(window, len(words))
            state, held = 0, 0
            for w in words:
                state, held = self.step[state][w], held + 1
                if held >= size:
                    self.items.setdefault(self._top(state, size), set()).add(item)
            if size < window:
                self.whole[self._top(state, size)] = size
        self._short: dict[int, tuple[int, ...]] = {}

    def _add(self, words: list[int]) -> None:
        step, link, length = self.step, self.link, self.length
        last = 0
        for w in words:
            if w in step[last]:
                q = step[last][w]
                last = q if length[q] == length[last] + 1 else self._clone(last, w, q)
                continue
            new = len(step)
            step.append({})
            link.append(0)
            length.append(length[last] + 1)
            p = last
            while p >= 0 and w not in step[p]:
                step[p][w] = new
                p = link[p]
            if p >= 0:
                q = step[p][w]
                link[new] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
            last = new

    def _clone(self, p: int, w: int, q: int) -> int:
        step, link, length = self.step, self.link, self.length
        copy = len(step)
        step.append(dict(step[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        while p >= 0 and step[p].get(w) == q:
            step[p][w] = copy
            p = link[p]
        link[q] = copy
        return copy

    def _top(self, state: int, size: int) -> int:
        """The state of the last ``size`` words of a match in ``state``."""
        while self.length[self.link[state]] >= size:
            state = self.link[state]
        return state

    def _whole_above(self, state: int) -> tuple[int, ...]:
        """States of whole short items on the way from a state to the start, itself first."""
        found = self._short.get(state)
        if found is None:
            at, path = state, []
            while at > 0:
                if at in self.whole:
                    path.append(at)
                at = self.link[at]
            found = self._short[state] = tuple(path)
        return found

    def spans(self, words: list[bytes]) -> tuple[list[list[int]], set]:
        """Merged [first, end) spans of hit words, and the items that occur."""
        step, link, length, window = self.step, self.link, self.length, self.window
        short = bool(self.whole)
        out: list[list[int]] = []
        items: set = set()
        state = held = 0
        for at, w in enumerate(map(self.vocab.get, words)):
            if w is None:
                state = held = 0
                continue
            while state and w not in step[state]:
                state = link[state]
                held = length[state]
            state = step[state].get(w, 0)
            held = held + 1 if state else 0
            size = 0
            if held >= window:
                size = window
                items |= self.items[self._top(state, window)]
            if short and held:
                for s in self._whole_above(state):
                    if self.whole[s] <= held:
                        size = max(size, self.whole[s])
                        items |= self.items[s]
            if size:
                first = at + 1 - size
                if out and first <= out[-1][1]:
                    out[-1][0] = min(out[-1][0], first)
                    out[-1][1] = at + 1
                    while len(out) > 1 and out[-1][0] <= out[-2][1]:
                        first, end = out.pop()
                        out[-1] = [min(out[-1][0], first), max(out[-1][1], end)]
                else:
                    out.append([first, at + 1])
        return out, items


def automata(benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS, item: str = "item_id", text: str = "text") -> Iterator[Automaton]:
    """One automaton for each block of items, a block holding about ``block_words`` words."""
    items = benchmark.select(col(item).alias("item"), col(text).cast("string").alias("text"))
    total = items.agg(F.sum(F.size(F.split("text", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")))).first()[0] or 0
    blocks = max(1, -(-total // block_words))
    for k in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k)
        yield Automaton([tuple(r) for r in part.collect()], window)


def merged(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for first, end in sorted(spans):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([first, end])
    return out


def matched(docs: DataFrame, benchmark: DataFrame, make, schema: str, keep: list[str], window: int = WINDOW, block_words: int = BLOCK_WORDS, text: str = "text") -> DataFrame:
    """The kept columns of every row and ``make(text, words, spans, items, search)`` of its matches.

    ``search`` finds the spans of other words against all blocks.
    """
    [own] = free_names(docs.select([col(c) for c in keep]), "_whole_text")
    frame = docs.select(*[col(c) for c in keep], col(text).cast("string").alias(own))
    added = StructType.fromDDL(schema)
    out = StructType([f for f in frame.schema.fields if f.name != own] + added.fields)
    sc = docs.sparkSession.sparkContext
    blocks = [sc.broadcast(a) for a in automata(benchmark, window, block_words)]
    n_kept = len(keep)

    def search(words: list[bytes]) -> tuple[list[list[int]], set]:
        spans: list[list[int]] = []
        items: set = set()
        for block in blocks:
            s, i = block.value.spans(words)
            spans += s
            items |= i
        return (merged(spans) if len(blocks) > 1 else spans), items

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [f.type for f in to_arrow_schema(added)]
        for batch in batches:
            for part in (batch.slice(k, 1024) for k in range(0, batch.num_rows, 1024)):
                rows = []
                for t in part.column(n_kept).to_pylist():
                    words = words_of(t)
                    rows.append(make(t, words, *search(words), search))
                made = [pa.array(list(v), k) for v, k in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays([*part.columns[:n_kept], *made], names=[*keep, *added.names])

    return frame.mapInArrow(run, out)


def digest(text, words, spans, items, search) -> tuple:
    hit = sum(b - a for a, b in spans)
    return len(words), hit, len(items), hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest(), hit > 0


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per document: words, hit words, items that occur and whether any word is hit."""
    return matched(docs, benchmark, digest, "n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean", ["doc_id"], window, block_words)


def cut_spans(text: str, spans: list[list[int]]) -> str:
    """The text without the words of the spans and what stands between them; a blank stands for each."""
    places = [m.span() for m in _WORD.finditer(text)]
    out, at = [], 0
    for first, end in spans:
        out.append(text[at : places[first][0]])
        at = places[end - 1][1]
    return " ".join([*out, text[at:]])


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_coverage: float = 0.5, block_words: int = BLOCK_WORDS, text: str = "text") -> DataFrame:
    """The documents without benchmark passages, in their columns.

    A document of which more than ``max_coverage`` of the words are hit goes; from others the
    hit spans are cut, again until none is left, since a cut can bring words together. Rows
    without a hit pass unchanged, NULL texts too.
    """

    def clean(t, words, spans, items, search):
        if not spans:
            return t, True
        if sum(b - a for a, b in spans) > max_coverage * len(words):
            return None, False
        while spans:
            t = cut_spans(t, spans)
            spans, _ = search(words_of(t))
        return t, True

    new, stays = free_names(docs, "_clean_text", "_stays")
    rest = [c for c in docs.columns if c != text]
    found = matched(docs, benchmark, clean, f"`{new}` string, `{stays}` boolean", rest, window, block_words, text)
    return found.where(col(stays)).select([col(new).alias(text) if c == text else col(c) for c in docs.columns])
