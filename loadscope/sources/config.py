"""Project configuration: environments of globs, and globs to ignore. Mistakes raise; nothing is skipped."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from loadscope.plans.dims import REACH
from loadscope.sources.errors import AnalysisError

SECTIONS = ("environments", "ignore")


@dataclass(frozen=True)
class Config:
    """Environments in their order, each with its globs; ignored globs."""

    environments: tuple[tuple[str, tuple[str, ...]], ...] = ()
    ignore: tuple[str, ...] = ()
    source: str = ""


def _bad(where: str, what: str) -> AnalysisError:
    return AnalysisError("bad-config", f"{where}: {what}", "A configuration that is partly read says less than it seems to.", "Correct the line and run again.")


def check_glob(glob: object, where: str) -> str:
    if not isinstance(glob, str) or not glob.strip():
        raise _bad(where, "a glob has to be text")
    plain = glob.replace("*", "x").replace("\\", "/")
    if re.match(r"/|[A-Za-z]:", plain) or ".." in plain.split("/") or "\0" in plain or not [p for p in plain.split("/") if p not in ("", ".")]:
        raise _bad(where, f"{glob!r} isn't a relative path within the project")
    return glob


def check_environment(name: str, where: str) -> str:
    if name not in REACH:
        raise _bad(where, f"{name!r} isn't an environment; those are {', '.join(REACH)}")
    return name


def parse_json(text: str, source: str) -> Config:
    try:
        doc = json.loads(text)
    except ValueError as e:
        raise _bad(source, f"not JSON ({e})") from e
    if not isinstance(doc, dict) or set(doc) - {*SECTIONS, "$schema"}:
        raise _bad(source, f"only {' and '.join(SECTIONS)} are known")
    envs, ignored = doc.get("environments", {}), doc.get("ignore", [])
    if not isinstance(envs, dict) or not isinstance(ignored, list) or not all(isinstance(g, list) for g in envs.values()):
        raise _bad(source, "environments maps names to lists of globs, ignore is a list of globs")
    return Config(tuple((check_environment(e, source), tuple(check_glob(g, source) for g in gs)) for e, gs in envs.items()), tuple(check_glob(g, source) for g in ignored), source)


def parse_yaml(text: str, source: str) -> Config:
    """The two levels that a configuration needs: sections, environments below one of them, and lists."""
    environments: dict[str, list[str]] = {}
    ignored: list[str] = []
    section, target = "", None
    for n, line in enumerate(text.splitlines(), 1):
        where, words = f"{source}:{n}", re.sub(r"(^|\s)#.*$", "", line).rstrip()
        if not words.strip():
            continue
        if "\t" in words:
            raise _bad(where, "a tab where spaces are needed")
        indent, words = len(words) - len(words.lstrip()), words.strip()
        if words.startswith("-"):
            if target is None:
                raise _bad(where, "a list item that belongs to nothing")
            target.append(check_glob(words[1:].strip().strip("\"'"), where))
        elif not words.endswith(":"):
            raise _bad(where, f"{words!r} is neither a name with a colon nor a list item")
        elif not indent:
            section = words[:-1].strip()
            if section not in SECTIONS:
                raise _bad(where, f"{section!r} isn't a section; those are {', '.join(SECTIONS)}")
            target = ignored if section == "ignore" else None
        elif section != "environments":
            raise _bad(where, "only environments has names below it")
        else:
            target = environments.setdefault(check_environment(words[:-1].strip().strip("\"'"), where), [])
    return Config(tuple((e, tuple(gs)) for e, gs in environments.items()), tuple(ignored), source)
