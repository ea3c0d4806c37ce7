"""Vocabulary files of public tokenizers, as the workers use them. Nothing is copied: files are opened by path."""

from __future__ import annotations

import base64
import json
import os
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


def split_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@lru_cache(maxsize=4)
def load_tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=4)
def load_pieces(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def description(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


@lru_cache(maxsize=8)
def splitter(pattern: str):
    return regex.compile(pattern)


@lru_cache(maxsize=8)
def special_strings(path: str) -> tuple[str, ...]:
    """Strings of a tokenizers file that become one token wherever they stand in a text, longest first."""
    return tuple(sorted((t["content"] for t in description(path)["added_tokens"]), key=len, reverse=True))


@lru_cache(maxsize=8)
def is_byte_level(path: str) -> bool:
    """Whether a tokenizers file splits text by the byte-level pattern alone and changes nothing before."""
    d = description(path)
    pre = d.get("pre_tokenizer") or {}
    plain = all(not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]) for t in d["added_tokens"])
    return d.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and plain


class Memo(dict):
    """What pieces of text were encoded to, forgotten when full so that a worker's memory stays bounded."""

    def __init__(self, most: int):
        super().__init__()
        self.most = most

    def room(self, n: int) -> None:
        if len(self) + n > self.most:
            self.clear()


#: Characters after which a word file's texts may be cut: it drops white space before it looks for words.
_WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def drops_space(path: str) -> bool:
    """Whether a tokenizers file splits words with _WORD_SPLIT, so that no token reaches over a space."""
    pre = description(path).get("pre_tokenizer") or {}
    first = (pre.get("pretokenizers") or [{}])[0]
    return first.get("type") == "Split" and first.get("pattern") == {"Regex": _WORD_SPLIT} and bool(first.get("invert"))


@lru_cache(maxsize=2)
def rank_encoding(path: str):
    """A byte-level tokenizers file as a rank encoding, or None where its ids aren't the ranks of its merges.

    Both libraries then join the same pairs in the same order; the rank form skips the bookkeeping of offsets.
    """
    import tiktoken

    d = description(path)
    model, vocab = d["model"], d["model"]["vocab"]
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    odd = [b for b in range(256) if b not in set(plain)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(odd)}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    if len(vocab) != 256 + len(pairs) or any(vocab.get(a + b) != 256 + i for i, (a, b) in enumerate(pairs)) or model.get("ignore_merges"):
        return None
    ranks = {bytes(byte_of[c] for c in t): i for t, i in vocab.items()}
    return tiktoken.Encoding("ranks", pat_str=split_pattern(), mergeable_ranks=ranks, special_tokens={t["content"]: t["id"] for t in d["added_tokens"]})


#: Letters, marks and a space or the end: the marks are one pre-token of their own. No apostrophe: that can open a contraction.
_MARKED = r"(\pL)([!-&(-/:-@\[-`{-~]+)( |$)"

#: Characters that lower-casing or composition could treat differently from one library to another.
_FOREIGN = r"[^\x00-\x{12F}\x{131}-\x{24F}]"


class IdEncoder:
    """Token ids of texts as the tokenizers library gives them, without begin or end tokens.

    Files that are byte-level go through their rank encoding. Files that drop white space are cut at it, and between words and
    the marks behind them, by vector operations; of the distinct words, Latin letters skip the steps that leave them as
    they are and go to the library's model, the others to the library. A worker remembers words until they are too many,
    then those of the last texts. Files of other kinds go to the library whole.
    """

    def __init__(self, path: str, most: int = 300_000):
        self.most, self.memo = most, {}
        self.specials = special_strings(path)
        self.ranks = rank_encoding(path) if is_byte_level(path) else None
        self.tok = load_tokenizer(path) if self.ranks is None else None
        self.by_word = self.ranks is None and drops_space(path)
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        odd = [b for b in range(256) if b not in set(plain)]
        self.shown = [chr(b) if b in set(plain) else chr(256 + odd.index(b)) for b in range(256)]

    def _learn(self, words: list[str]) -> None:
        odd, tokenize, memo, shown = [], self.tok.model.tokenize, self.memo, self.shown.__getitem__
        for w in words:
            if not w.isalpha() or max(w) >= "\u0250" or "İ" in w:
                odd.append(w)
                continue
            low = w.lower()
            memo[w] = array("I", [t.id for t in tokenize(low if low.isascii() else "".join(map(shown, low.encode())))]).tobytes()
        for w, e in zip(odd, self.tok.encode_batch_fast(odd, add_special_tokens=False), strict=True):
            memo[w] = array("I", e.ids).tobytes()

    def _bytes_of(self, words: list[str]) -> list[bytes]:
        memo = self.memo
        self._learn([w for w in words if w not in memo])
        ids = list(map(memo.__getitem__, words))
        if len(memo) > self.most:
            memo.clear()
            memo.update(zip(words, ids, strict=True))
        return ids

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each text's begin and end."""
        if self.by_word:
            texts = pc.replace_substring(texts, "\n", " ")
            if not pc.any(pc.match_substring_regex(texts, _FOREIGN)).as_py() and not any(pc.any(pc.match_substring(texts, s)).as_py() for s in self.specials):
                texts = pc.replace_substring_regex(pc.utf8_lower(texts), _MARKED, r"\1 \2\3")
            words = pc.split_pattern(texts, " ")
            coded = words.values.dictionary_encode()
            ids = self._bytes_of(coded.dictionary.to_pylist())
            sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
            pool = np.frombuffer(b"".join(ids), dtype=np.uint32)
            first = np.cumsum(sizes) - sizes
            of = coded.indices.to_numpy()
            n = sizes[of]
            ends = np.concatenate([[0], np.cumsum(n)])
            flat = pool[np.repeat(first[of] - ends[:-1], n) + np.arange(ends[-1])]
            return flat, ends[words.offsets.to_numpy()]
        if self.ranks is not None:
            found = [self.ranks.encode_to_numpy(t, allowed_special="all") for t in texts.to_pylist()]
        else:
            found = [np.array(e.ids, dtype=np.uint32) for e in self.tok.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
        return np.concatenate([*found, np.zeros(0, np.uint32)]).astype(np.uint32), np.concatenate([[0], np.cumsum([len(x) for x in found], dtype=np.int64)])


@lru_cache(maxsize=2)
def id_encoder(path: str) -> IdEncoder:
    return IdEncoder(path)


def text_blocks(texts: list[str], chars: int = 2_000_000):
    """Runs of texts of about so many characters; a longer text ends its run."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= chars:
            yield texts[at : i + 1]
            at, size = i + 1, 0
    if at < len(texts):
        yield texts[at:]


def encode_texts(texts: pa.Array, path: str, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts (null: empty), each followed by end_id, as uint32, and where each text's begin and end."""
    ids, ends = id_encoder(path).encode(texts.fill_null("") if texts.null_count else texts)
    if end_id is None:
        return ids, ends
    return np.insert(ids, ends[1:], end_id), ends + np.arange(len(ends))
