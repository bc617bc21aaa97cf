"""Settings from the environment or a file of ``NAME=value`` lines."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field


def parse_env(text: str) -> dict[str, str]:
    """Names and values; comments, ``export`` and quotes around values do not matter."""
    found = {}
    for line in text.splitlines():
        name, mark, value = line.strip().removeprefix("export ").partition("=")
        if mark and not name.startswith("#"):
            found[name.strip()] = value.strip().strip("'\"")
    return found


@dataclass(frozen=True)
class Settings:
    """What a refresh needs; passed as an argument, never read by operators."""

    inputs: tuple[str, ...] = ()
    output: str = ""
    pattern: str = r"\.csv$"
    values: tuple[str, ...] = ("Base Point",)
    policy: str = "skip"
    max_depth: int = 8
    extra: Mapping[str, str] = field(default_factory=dict)

    @staticmethod
    def of(env: Mapping[str, str] | None = None) -> Settings:
        env = dict(os.environ if env is None else env)
        listed = lambda name, default: tuple(x.strip() for x in env.get(name, default).split(",") if x.strip())
        policy = env.get("ON_CONFLICT", "skip").lower()
        if policy not in ("skip", "overwrite"):
            raise ValueError(f"ON_CONFLICT is {policy}")
        return Settings(listed("INPUTS", ""), env.get("OUTPUT", ""), env.get("PATTERN", r"\.csv$"), listed("VALUES", "Base Point"), policy, int(env.get("MAX_DEPTH", "8")), {k: v for k, v in env.items() if k.startswith("X_")})
