"""Sample inputs of one entity in two sources, and a projection configuration that fits them.

``python -m weftline.fixtures --output-dir DIR`` writes ``record.json``, ``notes.txt`` and ``config.json``.
"""

from __future__ import annotations

import argparse
import json
from pathlib import Path

RECORD = {
    "name": "Ilse van Dorn",
    "email": "Ilse@Boats.example",
    "phone_number": "0031 20 555 0142",
    "skills": ["Welding", "welding ", "Hydraulics", None],
    "location": {"country": "Netherlands", "city": "Delft"},
    "work_history": [
        {"company": "Harbour Crew", "title": "Foreman", "start": "March 2019", "end": "till date", "summary": "Two dry docks"},
        {"company": "Harbour Crew", "title": "Fitter", "start": "2014.06", "end": "02/2019"},
        {"company": "Delta Yard", "title": "Apprentice", "start": "2011"},
        {"company": "Unpaid", "title": ""},
    ],
    "education_history": [{"institution": "Harbour School", "degree": "Diploma"}, {"institution": "Delft Evening College", "field_of_study": "Hydraulics", "end": "2018-06"}],
}

NOTES = """2024: met Ilse on the quay. Write to ilse@boats.example, her old address crew7@harbour.example still works.
Pictures of her boats: https://dorn-boats.example/gallery (she has no other page).
"""

CONFIG = {
    "fields": [
        {"from": "education[-1].institution", "path": "last_school", "on_missing": "null", "format": "uppercase"},
        {"from": "experience[].title", "path": "career.titles", "on_missing": "omit", "format": "join_newline"},
        {"from": "experience[].company", "path": "career.places", "on_missing": "omit", "format": "count"},
        {"from": "emails[]", "path": "mail", "on_missing": "error"},
        {"from": "emails[7]", "path": "eighth_mail", "on_missing": "omit", "format": "lowercase"},
        {"from": "links.other[]", "path": "pages", "on_missing": "null", "format": "first"},
        {"from": "location", "path": "home", "on_missing": "null"},
        {"from": "full_name", "path": "person", "on_missing": "error", "format": "strip"},
    ],
    "flags": {"include_overall_confidence": False},
}


def write_record(folder: str | Path) -> Path:
    """The JSON record; gives its path."""
    return _write(Path(folder) / "record.json", json.dumps(RECORD, ensure_ascii=False, indent=2))


def write_notes(folder: str | Path) -> Path:
    """The text notes; gives their path."""
    return _write(Path(folder) / "notes.txt", NOTES)


def write_config(path: str | Path) -> Path:
    """The projection configuration; gives its path."""
    return _write(Path(path), json.dumps(CONFIG, ensure_ascii=False, indent=2))


def _write(path: Path, text: str) -> Path:
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return path


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="weftline.fixtures", description="Write sample inputs.")
    p.add_argument("--output-dir", default=".", help="where the inputs go")
    p.add_argument("--output", help="where the configuration goes, if not there")
    args = p.parse_args(argv)
    for path in (write_record(args.output_dir), write_notes(args.output_dir), write_config(args.output or Path(args.output_dir) / "config.json")):
        print(path)


if __name__ == "__main__":
    main()
