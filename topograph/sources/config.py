"""Project configuration: path aliases, the Go module and the Rust crate. Small files, read by the driver."""

from __future__ import annotations

import json
import posixpath
import re
from dataclasses import dataclass, field


def without_comments(text: str) -> str:
    """JSON with comments and trailing commas as JSON; strings are left alone."""
    kept = re.sub(r"(\"(?:\\.|[^\"\\])*\")|/\*.*?\*/|//[^\n]*", lambda m: m[1] or "", text, flags=re.S)
    return re.sub(r"(\"(?:\\.|[^\"\\])*\")|,(?=\s*[}\]])", lambda m: m[1] or "", kept)


@dataclass(frozen=True)
class Config:
    aliases: tuple[tuple[str, bool, tuple[str, ...]], ...] = ()  # prefix, whether anything may follow, targets
    go_module: str | None = None
    rust_crate: str | None = None
    base: str = field(default="")

    @staticmethod
    def of(tsconfig: str | None = None, go_mod: str | None = None, cargo: str | None = None) -> Config:
        """From the texts of tsconfig.json (or jsconfig.json), go.mod and Cargo.toml. What can't be read counts as absent."""
        aliases, base = [], ""
        try:
            options = json.loads(without_comments(tsconfig)).get("compilerOptions") or {} if tsconfig else {}
        except (ValueError, AttributeError):
            options = {}
        base = options.get("baseUrl") or ""
        for key, targets in (options.get("paths") or {}).items():
            targets = targets if isinstance(targets, list) else [str(targets)]
            aliases.append((key.partition("*")[0], "*" in key, tuple(posixpath.normpath(posixpath.join(base, t)) for t in targets)))
        go = re.search(r"^\s*module\s+(\S+)", go_mod or "", re.M)
        crate = re.search(r"^\s*name\s*=\s*\"([^\"]+)\"", cargo or "", re.M)
        return Config(tuple(aliases), go and go[1], crate and crate[1], base)

    @staticmethod
    def load(root: str) -> Config:
        def text(*names: str) -> str | None:
            for name in names:
                try:
                    with open(posixpath.join(root, name), encoding="utf-8") as f:
                        return f.read()
                except OSError:
                    continue
            return None

        return Config.of(text("tsconfig.json", "jsconfig.json"), text("go.mod"), text("Cargo.toml"))

    def expand(self, specifier: str) -> list[str]:
        """Targets of the first alias that fits."""
        for prefix, open_, targets in self.aliases:
            if specifier == prefix or (open_ and specifier.startswith(prefix)):
                return [t.replace("*", specifier[len(prefix) :], 1) for t in targets]
        return []
