"""Commands that other packages add to the command line.

A package names a class under the entry-point group hushjoin.extensions; the entry point has the command's name. The class is
made without arguments and has that name as `command`, and register(commands), which adds the command's parser to argparse's
subparsers and sets its default `run`, a function of (args, spark). Commands are added in the order of their names. One that
cannot be loaded, bears another name or one that is taken is left out with a warning.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterable
from importlib import metadata

GROUP = "hushjoin.extensions"


def _left_out(name: str, why: object) -> None:
    warnings.warn(f"extension {name} is left out: {why}", stacklevel=3)


def add_commands(commands, taken: Iterable[str], found: Iterable[metadata.EntryPoint] | None = None) -> list[str]:
    """Add the commands of all extensions (found: those of the installed packages) and return their names."""
    taken, added = set(taken), []
    for point in sorted(metadata.entry_points(group=GROUP) if found is None else found, key=lambda p: p.name):
        try:
            extension = point.load()()
            if getattr(extension, "command", None) != point.name:
                raise ValueError("its command has another name")
            if point.name in taken:
                raise ValueError("there is such a command")
            extension.register(commands)
        except Exception as e:  # whatever a foreign package raises must not take the other commands away
            _left_out(point.name, e)
        else:
            taken.add(point.name)
            added.append(point.name)
    return added
