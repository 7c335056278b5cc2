"""Options of an index build (D14, U4): typed, with unknown names rejected."""

from __future__ import annotations

from dataclasses import dataclass, fields

# The defaults of the reference behaviour.


@dataclass(frozen=True)
class Options:
    toc_check_pages: int = 20
    max_pages_per_node: int = 10
    max_tokens_per_node: int = 20_000
    chunk_tokens: int = 20_000
    chunk_overlap: int = 1
    add_node_id: bool = True
    add_node_text: bool = False
    add_node_summary: bool = True
    add_doc_description: bool = False
    fix_rounds: int = 3
    accept_above: float = 0.6
    summary_tokens: int = 200

    @classmethod
    def of(cls, **given) -> Options:
        """Options from keyword arguments (C14, X5); null keeps the default, yes and no are read as booleans."""
        kinds = {f.name: f.type for f in fields(cls)}
        unknown = sorted(set(given) - set(kinds))
        if unknown:
            raise ValueError(f"unknown options: {', '.join(unknown)}")
        out = {}
        for name, value in given.items():
            if value is None:
                continue
            if kinds[name] == "bool" and value in ("yes", "no"):
                value = value == "yes"
            want = {"bool": bool, "int": int, "float": (int, float)}[kinds[name]]
            if not isinstance(value, want) or (kinds[name] != "bool" and isinstance(value, bool)):
                raise TypeError(f"{name} must be {kinds[name]}")
            out[name] = value
        return cls(**out)
