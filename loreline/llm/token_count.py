"""Token counts with a whole-token shortcut."""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from loreline.llm.common import map_batches
from loreline.llm.tokenizer_files import Memo, is_byte_level, load_pieces, load_tokenizer, special_strings, split_pattern, splitter

#: Pre-tokens outside the vocabulary whose counts a worker remembers.
MEMO = 400_000


@lru_cache(maxsize=2)
def proven_tokens(path: str) -> frozenset[str]:
    """Vocabulary strings shown to encode alone as their own single token, by encoding each of them once.

    Only strings that the split pattern leaves whole can be met as a pre-token; the rest, and tokens that are not valid
    UTF-8 by themselves, are left out.
    """
    tok = load_tokenizer(path)
    whole = splitter(split_pattern())
    specials = set(special_strings(path))
    by_text = {tok.decoder.decode([t]): i for t, i in tok.get_vocab(with_added_tokens=False).items()}
    texts = [t for t in by_text if t and "�" not in t and t not in specials and whole.fullmatch(t) and whole.match(t).end() == len(t)]
    coded = tok.encode_batch_fast(texts, add_special_tokens=False)
    return frozenset(t for t, e in zip(texts, coded, strict=True) if e.ids == [by_text[t]])


_memos: dict[str, Memo] = {}


def _count_byte_level(texts: list[str], path: str) -> list[int]:
    tok, find, ones = load_tokenizer(path), splitter(split_pattern()).findall, proven_tokens(path)
    cut = splitter("|".join(map(_escape, special_strings(path)))) if special_strings(path) else None
    memo = _memos.setdefault(path, Memo(MEMO))
    pieces, extra = [], []
    for t in texts:
        parts = cut.split(t) if cut is not None and any(s in t for s in special_strings(path)) else [t]
        extra.append(len(parts) - 1)
        found = find(parts[0])
        for p in parts[1:]:
            found += find(p)
        pieces.append(found)
    rest = {p for found in pieces for p in found if p not in ones}
    memo.room(len(rest))
    new = [p for p in rest if p not in memo]
    memo.update(zip(new, (len(e.ids) for e in tok.encode_batch_fast(new, add_special_tokens=False)), strict=True))
    get = memo.get
    return [sum([get(p, 1) for p in found]) + n for found, n in zip(pieces, extra, strict=True)]


def _escape(s: str) -> str:
    import regex

    return regex.escape(s)


def count_texts(texts: list[str], path: str) -> list[int]:
    """Tokens of each text as the file's library gives them."""
    if path.endswith(".model"):
        return [len(x) for x in load_pieces(path).encode(texts, num_threads=1)]
    if is_byte_level(path):
        out: list[int] = []
        at, size = 0, 0
        for i, t in enumerate(texts):
            size += len(t)
            if size > 4_000_000:
                out += _count_byte_level(texts[at : i + 1], path)
                at, size = i + 1, 0
        return out + _count_byte_level(texts[at:], path)
    return [len(e.ids) for e in load_tokenizer(path).encode_batch_fast(texts, add_special_tokens=False)]


def count_tokens(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit of each document (doc_id, text; other columns are ignored).

    path: a .json file of the tokenizers library or a .model file of sentencepiece, read by every worker. No begin, end
    or added tokens, no truncation or padding; special strings in a text count as the library takes them by default.
    With byte-level files each pre-token found in proven_tokens counts as one; only the others are merged, each distinct
    one once while a worker remembers it. Files of other kinds go to their library whole. Null texts count as empty
    (0 tokens); repeated rows give a row each; no documents give no rows.
    """

    def run(batch: pa.RecordBatch) -> dict:
        texts = [t or "" for t in batch.column(1).to_pylist()]
        n = count_texts(texts, path)
        return {"doc_id": batch.column(0), "n_bytes": [len(t.encode()) for t in texts], "n_tokens": n, "over_limit": [x > limit for x in n]}

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean", rows=4000)
