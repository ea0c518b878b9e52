"""Token counts that follow edits: segment trees of pre-tokens."""

from __future__ import annotations

import base64
import importlib.util
import os
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

TOKENIZERS = "/opt/tokenizers"
RANKS = "byte_bpe_50k.tiktoken"
LEAF = 64  # pre-tokens of a leaf when the tree is built
CONTEXT = 3  # characters before an edit that a pre-token's end may have looked at
REDACTION = "<PII>"
PERSONAL = regex.compile(r"[\w.+-]+@[\w-]+\.[\w.-]+|\+?\d[\d ()-]{7,}\d|\b\d{1,3}(?:\.\d{1,3}){3}\b")


class TokenCounter(dict):
    """Tokens of one pre-token, by the public byte-level merges; pre-tokens never share a merge."""

    def __init__(self, folder: str):
        super().__init__()
        import tiktoken
        spec = importlib.util.spec_from_file_location("public_tokenizers", os.path.join(folder, "__init__.py"))
        public = importlib.util.module_from_spec(spec)
        spec.loader.exec_module(public)
        with open(os.path.join(folder, RANKS), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.pattern = regex.compile(public.PATTERN)
        self.encoding = tiktoken.Encoding("public", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __missing__(self, piece: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        value = self[piece] = len(self.encoding.encode_ordinary(piece))
        return value


class SegmentTree:
    """Pre-tokens in leaves; inner nodes hold the characters and tokens below them."""

    def __init__(self, text: str, counter: TokenCounter):
        self.text, self.counter, self.encoded = text, counter, 0
        pieces = counter.pattern.findall(text)
        size = max(1, -(-len(pieces) // LEAF))
        lengths, tokens = list(map(len, pieces)), list(map(counter.__getitem__, pieces))
        self.lengths = [lengths[i * LEAF:(i + 1) * LEAF] for i in range(size)]
        self.tokens = [tokens[i * LEAF:(i + 1) * LEAF] for i in range(size)]
        self.base = 1 << (size - 1).bit_length()
        self.chars, self.sums = [0] * (2 * self.base), [0] * (2 * self.base)
        for i in range(size):
            self.chars[self.base + i], self.sums[self.base + i] = sum(self.lengths[i]), sum(self.tokens[i])
        for i in range(self.base - 1, 0, -1):
            self.chars[i], self.sums[i] = self.chars[2 * i] + self.chars[2 * i + 1], self.sums[2 * i] + self.sums[2 * i + 1]

    @property
    def total(self) -> int:
        return self.sums[1]

    @property
    def pieces(self) -> int:
        return sum(map(len, self.lengths))

    def find(self, place: int) -> tuple[int, int]:
        """Leaf that holds character ``place`` and the characters before that leaf."""
        node, before = 1, 0
        while node < self.base:
            node *= 2
            if place >= before + self.chars[node] and self.chars[node + 1]:
                before += self.chars[node]
                node += 1
        return node - self.base, before

    def _refresh(self, leaves: Iterable[int]) -> None:
        nodes = set()
        for leaf in leaves:
            node = self.base + leaf
            self.chars[node], self.sums[node] = sum(self.lengths[leaf]), sum(self.tokens[leaf])
            nodes.add(node // 2)
        while nodes and max(nodes) >= 1:
            for node in nodes:
                self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
                self.sums[node] = self.sums[2 * node] + self.sums[2 * node + 1]
            nodes = {n // 2 for n in nodes if n > 1}

    def edit(self, start: int, end: int, put: str) -> None:
        """Replace text[start:end]. Matching is redone from a pre-token before the edit to the first old boundary after it."""
        leaf, at = self.find(max(0, start - CONTEXT))
        k = 0
        while k < len(self.lengths[leaf]) and at + self.lengths[leaf][k] <= max(0, start - CONTEXT):
            at += self.lengths[leaf][k]
            k += 1
        first, skip, begin = leaf, k, at
        moved = len(put) - (end - start)
        self.text = self.text[:start] + put + self.text[end:]
        # Walk old boundaries and new matches side by side until they agree past the edit.
        old, fresh = begin, []
        at = begin

        def advance() -> bool:
            nonlocal leaf, k, old
            while leaf < len(self.lengths) and k >= len(self.lengths[leaf]):
                leaf, k = leaf + 1, 0
            if leaf >= len(self.lengths):
                return False
            old += self.lengths[leaf][k]
            k += 1
            return True

        settled = start + len(put)
        while True:
            if at >= settled:
                while old < at - moved and advance():
                    pass
                if old == at - moved and old >= end:
                    break
            if at >= len(self.text):
                while advance():
                    pass
                break
            piece = self.counter.pattern.match(self.text, at).group()
            fresh.append(piece)
            at += len(piece)
        self.encoded += len(fresh)
        lengths, tokens = list(map(len, fresh)), list(map(self.counter.__getitem__, fresh))
        last = min(leaf, len(self.lengths) - 1)
        tail = k if leaf < len(self.lengths) else len(self.lengths[last])
        for kept, new in ((self.lengths, lengths), (self.tokens, tokens)):
            rest = kept[last][tail:]
            kept[first] = kept[first][:skip] + new + (rest if last == first else [])
            if last != first:
                kept[last] = rest
                for between in range(first + 1, last):
                    kept[between] = []
        self._refresh(range(first, last + 1))


def personal_spans(text: str) -> list[tuple[int, int, str]]:
    """Edits that redact addresses and long numbers, last first, so that each place holds when its turn comes."""
    return [(m.start(), m.end(), REDACTION) for m in PERSONAL.finditer(text)][::-1]


KIND = "key long, n_chars long, n_pretokens long, n_tokens long, n_edits long, n_reencoded long, n_chars_after long, n_tokens_after long"


def counts_after_edits(docs: DataFrame, folder: str = TOKENIZERS, spans=personal_spans, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Token counts of each row before and after its edits (``spans`` of the text: start, end, replacement, in order of use).

    Pre-tokens are counted once; after that an edit re-encodes only those it touches and the ones whose end could see it,
    and adds the change up the tree. The count equals that of encoding the edited text anew.

    Null and empty texts have no tokens and no edits. Rows that repeat a key give a row each. An empty table gives no rows; other
    columns are ignored. Half surrogates count as the replacement character.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TokenCounter(folder)
        names = [part.split()[0] for part in KIND.split(", ")]
        for batch in batches:
            rows = []
            for k, body in zip(batch.column("key").to_pylist(), batch.column("text"), strict=True):
                body = (body.as_py() or "").encode("utf-8", "replace").decode()
                tree, edits = SegmentTree(body, counter), spans(body)
                before, pieces = tree.total, tree.pieces
                for edit in edits:
                    tree.edit(*edit)
                rows.append((k, len(body), pieces, before, len(edits), tree.encoded, len(tree.text), tree.total))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(run, KIND).withColumnRenamed("key", key)


def op8(spark, sf_dir: str) -> DataFrame:
    return counts_after_edits(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
