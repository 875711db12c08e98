"""Vocabulary file of a byte-level BPE tokenizer (tokenizers' JSON): tokens as bytes, merge ranks, special strings.

The file's path is a parameter everywhere; a file is read on the driver and its content goes to executors as a
broadcast of the vocabulary's size (about 50,000 tokens).
"""

import json
from dataclasses import dataclass

#: Pre-tokens of byte-level BPE, a fixed public pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Letters and numbers of later Unicode versions, which the tokenizer library takes as symbols (fixed values: first-last, hexadecimal).
LATER = """
558-558 58b-58c 88f-88f c5c-c5c cdc-cdc 208f-208f 209d-209f a7ce-a7cf a7d2-a7d2 a7d4-a7d4 a7dd-a7dd a7e2-a7e2 a7f1-a7f1
ab6c-ab6d 107bb-107bf 10940-10959 10ec5-10ec7 10ed9-10eee 11b0a-11b0a 11db0-11ddb 11de0-11de9 11df1-11df1 1246f-1246f
12475-1247f 12550-12686 16ea0-16eb8 16ebb-16ed3 16ff2-16ff3 16ff4-16ff6 187f8-187ff 18cd6-18cda 18d09-18d20 18d80-18df2
18e00-19191 191a0-191d2 1b123-1b128 1b168-1b168 1d6a6-1d6a6 1df1f-1df24 1df2b-1df81 1df90-1df96 1dfcd-1dfff 1e6c0-1e6de
1e6e0-1e6e2 1e6e4-1e6e5 1e6e7-1e6ed 1e6f0-1e6f4 1e6fe-1e6ff 2b73a-2b73f 2b81e-2b81e 2cea2-2cead 323b0-33479 3d000-3fc3f
"""
LATER_RANGES = [tuple(int(x, 16) for x in r.split("-")) for r in LATER.split()]
LATER_SET = "[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in LATER_RANGES) + "]"
#: PATTERN for texts with such characters.
PATTERN_LATER = rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d| ?[\p{{L}}--{LATER_SET}]+| ?[\p{{N}}--{LATER_SET}]+| ?(?:[^\s\p{{L}}\p{{N}}]|{LATER_SET})+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the file: printable Latin-1 as itself, the rest from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@dataclass
class Vocabulary:
    """ids: token bytes to id; tokens: id to bytes; ranks: pair of ids to (rank, merged id); specials: string to id."""

    ids: dict[bytes, int]
    tokens: dict[int, bytes]
    ranks: dict[tuple[int, int], tuple[int, int]]
    specials: dict[str, int]


def load(path: str) -> Vocabulary:
    """Reads the file. Raises ValueError for a file of another kind."""
    if not path.endswith(".json"):
        raise ValueError("only byte-level BPE in a .json file is supported")
    with open(path, encoding="utf-8") as f:
        raw = json.load(f)
    pre = raw.get("pre_tokenizer") or {}
    if raw["model"]["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or raw.get("normalizer"):
        raise ValueError("only plain byte-level BPE is supported")
    letter = byte_letters()
    to_bytes = lambda s: bytes(letter[c] for c in s)
    vocab = raw["model"]["vocab"]
    ids = {to_bytes(k): v for k, v in vocab.items()}
    ranks = {}
    for n, pair in enumerate(raw["model"]["merges"]):
        a, b = pair.split(" ") if isinstance(pair, str) else pair
        ranks[vocab[a], vocab[b]] = (n, vocab[a + b])
    specials = {x["content"]: x["id"] for x in raw.get("added_tokens", [])}
    tokens = {v: k for k, v in ids.items()} | {v: k.encode() for k, v in specials.items()}
    return Vocabulary(ids, tokens, ranks, specials)
