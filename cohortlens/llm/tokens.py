"""Token ids of a public byte-level BPE vocabulary inside tasks.

The ids are those of the ``tokenizers`` library for the given file.  If the file of the same
vocabulary as ranks is named too, texts whose characters all lie below U+0250 and that hold no
special token go through ``tiktoken``, which gives the same ids several times faster.
"""

from __future__ import annotations

import base64
import os
import re

import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

BYTE_BPE, BYTE_RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
_OTHER = re.compile("[ɐ-\U0010ffff\x1c-\x1f\x85]|<\\|")


class Encoder:
    """Encodes one text at a time; made once per task."""

    def __init__(self, tokenizer: str, ranks: str | None = None) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.slow = Tokenizer.from_file(tokenizer)
        self.fast = None
        if ranks:
            with open(ranks, "rb") as lines:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding(
                "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}
            )

    def ids(self, text: str) -> list[int]:
        if self.fast is not None and not _OTHER.search(text):
            return self.fast.encode_ordinary(text)
        return self.slow.encode(text, add_special_tokens=False).ids
