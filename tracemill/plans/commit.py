"""A run's outputs as one transaction: staged, made binding by one manifest, then put in place.

Everything that a run leaves is first written under ``.staging/<run>``, where each file has the place that it will have
under the root. The manifest names them; writing it is one rename, and from then on the run has happened. Putting a file in
place is a rename too, and may be done twice. After a crash ``recover`` finishes a run that has its manifest and throws away
one that has not, so a reader sees either nothing of a run or, after recovery, all of it. The state goes last but one and
the run's own record last, as these are what the next run builds on.
"""

from __future__ import annotations

import os
import shutil
from pathlib import Path

from tracemill.sources import control

STAGING, MANIFEST = ".staging", "manifest.json"
LAST = ("state.json", "runs/")


def step(name: str) -> None:
    """Called before each thing that can be interrupted; tests make it fail."""


class Commit:
    def __init__(self, root: Path, run_id: str):
        self.root, self.stage = root, root / STAGING / run_id
        self.gone: list[str] = []

    def path(self, place: str) -> Path:
        """Where to stage what is to have this place."""
        out = self.stage / place
        out.parent.mkdir(parents=True, exist_ok=True)
        return out

    def write_json(self, place: str, data) -> None:
        step(f"stage {place}")
        control.write_json(self.path(place), data)

    def write_text(self, place: str, text: str) -> None:
        step(f"stage {place}")
        self.path(place).write_text(text, encoding="utf-8")

    def remove(self, place: str) -> None:
        """A file that goes when the run's own are in place."""
        self.gone.append(place)

    def staged(self) -> list[str]:
        found = (p.relative_to(self.stage).as_posix() for p in self.stage.rglob("*") if p.is_file())
        kept = [p for p in found if not p.rsplit("/", 1)[-1].startswith((".", "_"))]  # Spark's own marks stay behind
        return sorted(kept, key=lambda p: ([p.startswith(x) for x in LAST].index(True) + 1 if p.startswith(LAST) else 0, p))

    def finish(self) -> None:
        manifest = {"moves": self.staged(), "removals": self.gone}
        step("manifest")
        control.write_json(self.stage / MANIFEST, manifest)
        _replay(self.root, self.stage)


def _replay(root: Path, stage: Path) -> None:
    manifest = control.read_json(stage / MANIFEST)
    for place in manifest["moves"]:
        if (stage / place).exists():  # else it is in place already
            step(f"place {place}")
            (root / place).parent.mkdir(parents=True, exist_ok=True)
            os.replace(stage / place, root / place)
    for place in manifest["removals"]:
        step(f"remove {place}")
        (root / place).unlink(missing_ok=True)
    step("clear")
    (stage / MANIFEST).rename(stage / f".{MANIFEST}")  # what is left is rubbish from here on
    shutil.rmtree(stage)


def recover(root: Path) -> list[str]:
    """Finish or drop what earlier runs have left; the names of those that were finished."""
    done = []
    for stage in sorted((root / STAGING).glob("*")):
        if (stage / MANIFEST).exists():
            _replay(root, stage)
            done.append(stage.name)
        else:
            shutil.rmtree(stage)
    return done
