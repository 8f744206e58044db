"""What a user keeps between searches: defaults, marks, history and named forms, in one JSON file."""

from __future__ import annotations

import dataclasses
import json
import os
import time
from collections.abc import Iterable
from dataclasses import dataclass, field
from pathlib import Path

#: Fixed value: queries that the history remembers.
MOST_HISTORY = 200
MODES = ("fast", "standard", "full")
POLICIES = ("auto", "skip", "fetch")


@dataclass
class Settings:
    """Defaults of a search, and what was searched before."""

    roots: list[str] = field(default_factory=list)
    query: str = ""
    mode: str = "standard"
    policy: str = "auto"
    spaces: str = "OR"
    case_sensitive: bool = False
    ignore_width: bool = True
    part_number_mode: bool = False
    include_path_names: bool = True
    subfolders: bool = True
    kinds: list[str] = field(default_factory=lambda: ["excel", "pdf", "word", "ppt", "text", "?"])
    limits: dict[str, int] = field(default_factory=dict)
    index_path: str = ""
    index_max_bytes: int = 0
    confirmed: list[str] = field(default_factory=list)
    history: list[str] = field(default_factory=list)
    recent_roots: list[str] = field(default_factory=list)
    presets: dict[str, dict] = field(default_factory=dict)

    @classmethod
    def load(cls, path: str | os.PathLike[str]) -> Settings:
        """Settings of a file; defaults if there is none. A broken file is put aside, values of another kind are dropped."""
        path = Path(path)
        if not path.exists():
            return cls()
        try:
            held = json.loads(path.read_text("utf-8"))
            if not isinstance(held, dict):
                raise TypeError("not an object")
        except (ValueError, TypeError):
            path.replace(path.with_suffix(f".broken-{int(time.time())}"))
            return cls()
        out, plain = cls(), cls()
        for f in dataclasses.fields(cls):
            if f.name in held and type(held[f.name]) is type(getattr(plain, f.name)):
                setattr(out, f.name, held[f.name])
        out.mode = out.mode if out.mode in MODES else plain.mode
        out.policy = out.policy if out.policy in POLICIES else plain.policy
        return out

    def save(self, path: str | os.PathLike[str]) -> None:
        """Write the file whole: readers see it as it was or as it is."""
        path = Path(path)
        path.parent.mkdir(parents=True, exist_ok=True)
        part = path.with_suffix(f".{os.getpid()}.part")
        part.write_text(json.dumps(dataclasses.asdict(self), ensure_ascii=False, indent=1), "utf-8")
        os.replace(part, path)

    def remember(self, query: str, roots: Iterable[str] = ()) -> None:
        """Put a query and its roots first in the lists of what was searched."""
        if query:
            self.history = [query, *(q for q in self.history if q != query)][:MOST_HISTORY]
        self.recent_roots = list(dict.fromkeys([*roots, *self.recent_roots]))[:MOST_HISTORY]

    def toggle_confirmed(self, path: str) -> bool:
        """Mark a file as confirmed, or take the mark away; returns whether it has it now."""
        if path in self.confirmed:
            self.confirmed.remove(path)
            return False
        self.confirmed.append(path)
        return True

    def keep_preset(self, name: str) -> None:
        """Keep the present defaults under a name."""
        kept = dataclasses.asdict(self)
        self.presets[name] = {k: v for k, v in kept.items() if k not in ("confirmed", "history", "recent_roots", "presets")}

    def apply_preset(self, name: str) -> None:
        for k, v in self.presets[name].items():
            setattr(self, k, v)
