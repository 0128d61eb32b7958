"""Driver-side parsers of the command-line forms, with exact errors."""

from __future__ import annotations

import re

PROTOTYPES = ("rocksalt", "garnet", "spinel", "doubleperovskite", "pyrochlore", "ilmenite")
#: Tags that a prototype needs. Fixed values.
REQUIRED_TAGS = {"rocksalt": {"Q0"}, "garnet": {"J0", "Q0"}, "spinel": {"Q0"}, "doubleperovskite": {"J0", "Q0"}, "pyrochlore": {"Q0"}, "ilmenite": {"Q0"}}
#: Cell parameters and their defaults, None for those that must be given. Fixed values.
PARAMETERS = {"rocksalt": {"a": None}, "garnet": {"a": None}, "spinel": {"a": None, "u": 0.36}, "doubleperovskite": {"a": None, "u": 0.26}, "pyrochlore": {"a": None, "x": None}, "ilmenite": {"a": None, "c": None}}
_TOKEN = re.compile(r"([A-Z]\d+)([A-Z][a-z]{0,2})")


def _parts(text: str, separator: str) -> list[str]:
    return [p.strip() for p in text.split(separator) if p.strip()]


def cutoffs(text: str) -> dict[int, float]:
    """``2:10,3:8`` as {2: 10.0, 3: 8.0}; empty parts are skipped, the last of equal orders holds."""
    out = {}
    for part in _parts(text, ","):
        order, _, radius = part.partition(":")
        out[int(order)] = float(radius)
    if not out:
        raise ValueError("no cutoffs given")
    return out


def counts(text: str) -> dict[str, int]:
    """``Fe:54,Mn:46`` as {"Fe": 54, "Mn": 46}."""
    out: dict[str, int] = {}
    for part in _parts(text, ","):
        element, colon, n = (x.strip() for x in part.partition(":"))
        if not colon:
            raise ValueError(f"no colon in {part!r}")
        if not element:
            raise ValueError(f"no element in {part!r}")
        if element in out:
            raise ValueError(f"{element} is given twice")
        if int(n) < 0:
            raise ValueError(f"negative count in {part!r}")
        out[element] = int(n)
    if not out:
        raise ValueError("no counts given")
    return out


def outer_parts(text: str) -> list[str]:
    """Parts between commas that stand outside braces."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(text):
        depth += (c == "{") - (c == "}")
        if depth < 0:
            raise ValueError(f"a closing brace too many in {text!r}")
        if c == "," and depth == 0:
            out.append(text[start:i])
            start = i + 1
    if depth:
        raise ValueError(f"an open brace in {text!r}")
    return [p.strip() for p in [*out, text[start:]] if p.strip()]


def composition_map(text: str) -> dict[str, dict[str, int]]:
    """``Es:{Mg:16},Fm:{Al:32}`` as nested counts."""
    out: dict[str, dict[str, int]] = {}
    for part in outer_parts(text):
        m = re.fullmatch(r"([^:{}]+):\{([^{}]*)\}", part)
        if m is None:
            raise ValueError(f"not sublattice:{{counts}}: {part!r}")
        if m[1].strip() in out:
            raise ValueError(f"{m[1].strip()} is given twice")
        out[m[1].strip()] = counts(m[2])
    if not out:
        raise ValueError("no sublattices given")
    return out


def mixture(text: str, seed: int = 0) -> dict:
    """``composition_map=...;K=50;seed=123``; names in either case, ``seed`` where none is given."""
    found = {}
    for part in _parts(text, ";"):
        name, equals, value = (x.strip() for x in part.partition("="))
        name = name.lower()
        if not equals or name not in ("composition_map", "k", "seed"):
            raise ValueError(f"unknown part {part!r}")
        found[name] = value
    if "composition_map" not in found or "k" not in found:
        raise ValueError("a mixture needs composition_map and K")
    return {"composition_map": composition_map(found["composition_map"]), "K": int(found["k"]), "seed": int(found.get("seed", seed))}


def prototype(text: str) -> tuple[str, dict[str, str]]:
    """``doubleperovskite_J0Sr_Q0O`` as (name, {"J0": "Sr", "Q0": "O"})."""
    name, *tokens = text.split("_")
    if name not in PROTOTYPES:
        raise ValueError(f"unknown prototype {name!r}")
    out: dict[str, str] = {}
    for token in tokens:
        m = _TOKEN.fullmatch(token)
        if m is None or m[1][0] not in "JQ":
            raise ValueError(f"bad tag {token!r}")
        if m[1] in out:
            raise ValueError(f"tag {m[1]} is given twice")
        out[m[1]] = m[2]
    exact_keys(set(out), REQUIRED_TAGS[name], f"tags of {name}")
    return name, out


def exact_keys(given: set[str], wanted: set[str], what: str) -> None:
    if given != wanted:
        raise ValueError(f"{what}: missing {sorted(wanted - given)}, not known {sorted(given - wanted)}")


def parameters(name: str, params: dict[str, float]) -> dict[str, float]:
    """A prototype's parameters with defaults; missing, unknown, non-numeric and non-positive ones fail."""
    known = PARAMETERS[name]
    if extra := set(params) - set(known):
        raise ValueError(f"unknown parameters {sorted(extra)}")
    out = {}
    for key, default in known.items():
        value = params.get(key, default)
        if value is None:
            raise ValueError(f"{name} needs {key}")
        if not isinstance(value, int | float) or isinstance(value, bool) or value <= 0:
            raise ValueError(f"{key} must be a positive number")
        out[key] = float(value)
    if name == "pyrochlore" and not out["x"] < 1:
        raise ValueError("x must be below 1")
    return out


def frozen(text: str) -> tuple[str, ...]:
    """A comma list of sublattices, which must be sorted and without repeats already."""
    parts = [p.strip() for p in text.split(",") if p.strip()]
    if ",".join(sorted(set(parts))) != text:
        raise ValueError(f"frozen sublattices must be sorted and unique: {text!r}")
    return tuple(parts)
