"""Settings of the corpus operators, and a reader of nested settings with environment substitution."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass
from typing import Any


@dataclass(frozen=True)
class Settings:
    min_text_length: int = 50
    min_words: int = 5
    chunk_tokens: int = 800
    chunk_overlap: int = 150
    min_chunk_tokens: int = 100
    max_gap: float = 2.0


_VARIABLE = re.compile(r"\$\{(\w+)\}")


def substituted(node: Any) -> Any:
    """`${NAME}` in values of mappings becomes the environment's value (unset: left as it is); items of lists stay as they are."""
    if not isinstance(node, dict):
        return node
    return {k: _VARIABLE.sub(lambda m: os.environ.get(m[1], m[0]), v) if isinstance(v, str) else substituted(v) for k, v in node.items()}


def lookup(tree: dict, path: str, default: Any = None) -> Any:
    """The value at a dotted path, or default where a step is missing."""
    node: Any = tree
    for step in path.split("."):
        if not isinstance(node, dict) or step not in node:
            return default
        node = node[step]
    return node


def load(path: str) -> dict:
    """Settings of a YAML file."""
    import yaml

    with open(path, encoding="utf-8") as f:
        return substituted(yaml.safe_load(f) or {})
