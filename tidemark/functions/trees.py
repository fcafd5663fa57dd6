"""Nested settings as dictionaries: merge, look up, set, compare."""

from __future__ import annotations

from collections.abc import Callable, Iterator


def leaves(tree: dict, at: tuple = ()) -> Iterator[tuple[tuple, object]]:
    """(path, value) of everything that is no dictionary, or an empty one."""
    for k, v in tree.items():
        if isinstance(v, dict) and v:
            yield from leaves(v, (*at, k))
        else:
            yield (*at, k), v


def merged(tree: dict, changes: dict) -> dict:
    """A copy of tree with changes laid over it, dictionary by dictionary."""
    return tree | {k: merged(tree[k], v) if isinstance(v, dict) and isinstance(tree.get(k), dict) else v for k, v in changes.items()}


def mapped(tree: dict, f: Callable[[object], object]) -> dict:
    """A copy with f of every value that is no dictionary."""
    return {k: mapped(v, f) if isinstance(v, dict) else f(v) for k, v in tree.items()}


def get(tree: dict, path: str, default=None):
    """The value at a dotted path."""
    for k in path.split("."):
        if not isinstance(tree, dict) or k not in tree:
            return default
        tree = tree[k]
    return tree


def with_value(tree: dict, path: str, value) -> dict:
    """A copy with a value at a dotted path; what is missing on the way is made."""
    first, _, rest = path.partition(".")
    below = tree.get(first)
    return tree | {first: with_value(below if isinstance(below, dict) else {}, rest, value) if rest else value}


def differences(one: dict, two: dict) -> dict[str, list[str]]:
    """Dotted paths that only one has, only two has, or that have other values: only_first, only_second, different."""
    a, b = ({".".join(map(str, p)): v for p, v in leaves(t)} for t in (one, two))
    return {"only_first": sorted(a.keys() - b.keys()), "only_second": sorted(b.keys() - a.keys()), "different": sorted(k for k in a.keys() & b.keys() if a[k] != b[k])}
