"""Intermediate tables in the folder that the whole cluster shares, and free column names."""

from collections.abc import Iterable

from veridock.plans.scratch import materialise, release, shared_dir

__all__ = ["fresh", "materialise", "release", "shared_dir"]


def fresh(columns: Iterable[str], *names: str) -> list[str]:
    """``names``, each with as many underscores behind it as it takes to differ
    from ``columns`` (Spark compares names without case)."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
