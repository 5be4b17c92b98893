"""Settings of a run, their rules, and views of them."""

from __future__ import annotations

import dataclasses

FILES = {"hierarchy": "hierarchy.json", "references": "refs.bib", "metadata": "metadata.json", "candidates": "references.json", "predictions": "pred.json", "statistics": "parsing_stats.json"}


@dataclasses.dataclass(frozen=True)
class Settings:
    root: str = "output"
    model_root: str = "models"
    model_type: str = "ranker"
    top_k: int = 5
    min_manual_publications: int = 5
    min_manual_labels: int = 20
    min_auto_share: float = 0.1
    title_similarity: float = 0.95
    author_overlap: float = 0.8
    test_manual: int = 1
    test_auto: int = 1
    valid_manual: int = 1
    valid_auto: int = 1
    seed: int = 42

    def faults(self) -> list[str]:
        """Rules that the settings break, in words; [] if none."""
        rules = [
            (self.min_manual_publications >= 5, "at least 5 publications are labelled by hand"),
            (self.min_manual_labels >= 20, "at least 20 labels are given by hand"),
            (self.min_auto_share >= 0.1, "at least a tenth of the other publications is labelled automatically"),
            (0 <= self.title_similarity <= 1, "title similarity lies between 0 and 1"),
            (0 <= self.author_overlap <= 1, "author overlap lies between 0 and 1"),
            (self.top_k == 5, "five candidates are ranked"),
            (self.test_manual == self.test_auto == 1, "one manual and one automatic publication test"),
            (self.valid_manual == self.valid_auto == 1, "one manual and one automatic publication validate"),
            (self.model_type in ("classifier", "ranker"), "the model is a classifier or a ranker"),
        ]
        return [says for holds, says in rules if not holds]

    def checked(self) -> Settings:
        """The settings themselves; ValueError where a rule is broken."""
        if faults := self.faults():
            raise ValueError("settings: " + "; ".join(faults))
        return self

    def path(self, publication: str, kind: str) -> str:
        """Place of a publication's file of one of the FILES kinds."""
        return f"{self.root.rstrip('/')}/{publication}/{FILES[kind]}"

    def model_path(self, name: str) -> str:
        return f"{self.model_root.rstrip('/')}/{name}"

    def view(self, *names: str) -> dict:
        """The named settings, all without names."""
        every = dataclasses.asdict(self)
        return {n: every[n] for n in names} if names else every

    def labelling(self) -> dict:
        return self.view("min_manual_publications", "min_manual_labels", "min_auto_share")

    def splitting(self) -> dict:
        return self.view("test_manual", "test_auto", "valid_manual", "valid_auto", "seed")
