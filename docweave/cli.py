"""``python -m docweave.cli generate``: a Python module of index definitions from their JSON."""

from __future__ import annotations

import argparse
import json
import pprint
import sys
from pathlib import Path

NAME = "indexes.json"


def find(start: Path) -> Path:
    """The nearest definitions in a folder, its ``functions`` folder, or those above."""
    tried = []
    for folder in (start, *start.parents):
        for place in (folder, folder / "functions"):
            for found in sorted(place.glob(f"*{NAME}")):
                return found
            tried.append(str(place))
    raise FileNotFoundError(f"No *{NAME} in {', '.join(tried)}")


def module_text(content: dict) -> str:
    """A module with the definitions as data."""
    if not isinstance(content.get("indexes"), list):
        raise ValueError("The definitions have no list of indexes")
    return f'"""Index definitions, for Indexes.load."""\n\nINDEXES = {pprint.pformat(content, width=100, sort_dicts=False)}\n'


def generate(source: Path, output: Path) -> Path:
    """Write a module with the definitions as data, and return its path."""
    text = module_text(json.loads(source.read_text(encoding="utf-8")))
    output.mkdir(parents=True, exist_ok=True)
    target = output / "index_definitions.py"
    target.write_text(text, encoding="utf-8")
    return target


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="docweave")
    commands = parser.add_subparsers(dest="command", required=True)
    make = commands.add_parser("generate", help="write a module of index definitions")
    make.add_argument("--indexes-json", type=Path, help="the definitions; by default the nearest above the current folder")
    make.add_argument("--output-dir", type=Path, default=Path("generated"))
    options = parser.parse_args(arguments)
    try:
        source = options.indexes_json or find(Path.cwd())
        if not source.is_file():
            raise FileNotFoundError(f"Not found: {source.resolve()}")
        print(generate(source, options.output_dir).resolve())
    except (OSError, ValueError) as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
