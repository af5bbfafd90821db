"""Chat formatting on tokens: segments are encoded one by one and joined by reserved ids.

A turn is ``<|turn|>role<|text|>text<|end|>``. The three marks are reserved ids, so no text can make one; for the
string form, ``<|`` inside a role or text is written ``<\\|`` and a backslash twice, which is undone on reading.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitlake.llm.common import TEXT_ROWS, columns, map_batches
from pitlake.llm.token_counts import byte_characters

#: The marks in the order of their reserved ids, which follow the vocabulary.
MARKS = ("<|turn|>", "<|text|>", "<|end|>")
ESCAPED = re.compile(r"\\([\\|])")


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


class ChatCodec:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.first_mark = self.tokenizer.get_vocab_size(with_added_tokens=True)
        chars = byte_characters()
        self.bytes_of = {i: bytes(chars[c] for c in t) for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if all(c in chars for c in t)}

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; few at a time, as the library's own results take far more room than the ids."""
        out = []
        for first in range(0, len(texts), 64):
            out += [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch(texts[first : first + 64], add_special_tokens=False)]
        return out

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "surrogatepass")


_codecs: dict[str, ChatCodec] = {}


def codec(path: str) -> ChatCodec:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _codecs:
        _codecs[path] = ChatCodec(path)
    return _codecs[path]


def format_conversations(turns: DataFrame, tokenizer: str, learned_role: str = "assistant") -> DataFrame:
    """``conv_id, ids, loss_mask`` (little-endian uint32, and a byte each) for every conversation of ``turns``.

    Rows go by turn, then role and text (nulls first), so ties and repeated rows have a fixed order; each row is a
    turn. A null role or text is empty; rows with a null conv_id form one conversation. The mask covers the ids of
    the texts of ``learned_role`` and nothing else. Turns are encoded before they are grouped, in parallel.
    """

    def encode(batches: Iterator[dict]) -> Iterator[dict]:
        c = codec(tokenizer)
        turn, text, end = range(c.first_mark, c.first_mark + 3)
        for b in batches:
            roles, texts = c.encode([escape(r or "") for r in b["role"]]), c.encode([escape(t or "") for t in b["text"]])
            yield b | {
                "ids": [np.concatenate(([turn], r, [text], t, [end])).astype("<u4").tobytes() for r, t in zip(roles, texts, strict=True)],
                "start": [len(r) + 2 for r in roles],
                "learned": [len(t) if role == learned_role else 0 for role, t in zip(b["role"], texts, strict=True)],
            }

    def assemble(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            out: dict[str, list] = {"conv_id": b["conv_id"], "ids": [], "loss_mask": []}
            for rows in b["turns"]:
                sizes = np.array([len(r["ids"]) // 4 for r in rows])
                firsts = np.cumsum(sizes) - sizes + np.array([r["start"] for r in rows])
                edges = np.zeros(int(sizes.sum()) + 1, dtype=np.int32)
                np.add.at(edges, firsts, 1)
                np.add.at(edges, firsts + np.array([r["learned"] for r in rows]), -1)
                out["ids"].append(b"".join(r["ids"] for r in rows))
                out["loss_mask"].append(np.cumsum(edges[:-1]).astype(np.uint8).tobytes())
            yield out

    rows = columns(turns, conv_id="long", turn="long", role="string", text="string")
    encoded = map_batches(rows, encode, "conv_id long, turn long, role string, text string, ids binary, start int, learned int", TEXT_ROWS)
    grouped = encoded.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "ids", "start", "learned"))).alias("all"))
    slim = grouped.select("conv_id", F.transform("all", lambda t: F.struct(t.ids.alias("ids"), t.start.alias("start"), t.learned.alias("learned"))).alias("turns"))
    return map_batches(slim, assemble, "conv_id long, ids binary, loss_mask binary")


def read_back(ids: bytes, mask: bytes, c: ChatCodec) -> tuple[list[tuple[str, str]], str, int]:
    """Turns (role, text), the text under the mask, and the code points of the string form, from ids and mask."""
    all_ids, learned = np.frombuffer(ids, "<u4"), np.frombuffer(mask, np.uint8)
    marks = np.flatnonzero(all_ids >= c.first_mark)
    turns, chars = [], sum(len(MARKS[m]) for m in (all_ids[marks] - c.first_mark).tolist())
    for a, b, e in marks.reshape(-1, 3).tolist():
        role, text = c.decode(all_ids[a + 1 : b]), c.decode(all_ids[b + 1 : e])
        chars += len(role) + len(text)
        turns.append((unescape(role), unescape(text)))
    edges = np.flatnonzero(np.diff(np.concatenate(([0], learned, [0])).astype(np.int8)))
    return turns, "".join(unescape(c.decode(all_ids[a:b])) for a, b in edges.reshape(-1, 2).tolist()), chars
