"""Terminology profiles, project files, and the terms that hold for a path."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import glossary, lexicon

#: Our own built-in profiles: id, domain, terms (canonical, roles).
BUILT_IN = {
    "software-core": ("software", [("file", ["noun"]), ("folder", ["noun"]), ("server", ["noun"]), ("compile", ["verb"])]),
    "git": ("version control", [("commit", ["noun", "verb"]), ("branch", ["noun"]), ("rebase", ["verb"])]),
    "github": ("code hosting", [("pull request", ["noun"]), ("fork", ["noun", "verb"])]),
}
CONFIG_FIELDS = {"schema", "profiles"}
CONFIG, TERMS, CONTEXT = ".plainlane/config.json", ".plainlane/terms.json", ".plainlane/context.json"
#: Environment variable that names the lexicon file, where no path is given.
LEXICON_VARIABLE = "PLAINLANE_LEXICON"


def listed(spark: SparkSession) -> DataFrame:
    """(id, domain, n_terms) of the built-in profiles."""
    return spark.createDataFrame([(k, d, len(t)) for k, (d, t) in BUILT_IN.items()], "id string, domain string, n_terms int")


def shown(spark: SparkSession, profile: str) -> DataFrame:
    """The terms of a built-in profile; an unknown id is an error."""
    if profile not in BUILT_IN:
        raise ValueError(f"unknown terminology profile {profile!r}")
    return glossary.terms_frame(spark, [{"id": f"{profile}/{c.replace(' ', '-')}", "canonical": c, "roles": r, "status": "approved"} for c, r in BUILT_IN[profile][1]])


def parse_config(text: str) -> list[str]:
    """The profile ids of a project config; unknown fields, ids that are no strings and repeated ids are errors."""
    data = json.loads(text)
    unknown = set(data) - CONFIG_FIELDS if isinstance(data, dict) else {"(no object)"}
    if unknown:
        raise ValueError(f"unknown fields in the project config: {', '.join(sorted(unknown))}")
    ids = data.get("profiles", [])
    if not all(isinstance(x, str) for x in ids):
        raise ValueError("profiles must be strings")
    if len(set(ids)) != len(ids):
        raise ValueError("a terminology profile is named twice")
    return ids


def project_file(path: str, relative: str) -> str | None:
    """The file of that relative name in the folder of path or the nearest folder above it. On the driver's own files."""
    folder = path if os.path.isdir(path) else os.path.dirname(os.path.abspath(path))
    folder = os.path.abspath(folder)
    while True:
        found = os.path.join(folder, relative)
        if os.path.isfile(found):
            return found
        above = os.path.dirname(folder)
        if above == folder:
            return None
        folder = above


def nearest(paths: DataFrame, files: DataFrame) -> DataFrame:
    """(path, file): for each path of a table the file (folder, file) whose folder is the nearest one above it; for many
    projects at once. A path's folders are few, so they are exploded and joined by equality."""
    parts = F.split(F.regexp_replace("path", "/[^/]*$", ""), "/")
    up = paths.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, 1, k), "/").alias("folder")))).alias("u"))
    found = up.select("path", "u.*").join(files, "folder").groupBy("path").agg(F.max_by("file", "depth").alias("file"))
    return paths.join(found, "path", "left")


@dataclass
class Effective:
    """The terms that hold for a path and where they come from; terms is None where there are none."""

    profiles: list[str]
    project_terms: str | None
    terms: DataFrame | None

    def report(self) -> DataFrame | None:
        return None if self.terms is None else self.terms.select("id", "canonical", "roles", "status", "replacement")


def effective_glossary(spark: SparkSession, path: str) -> Effective:
    """The terms of the profiles that the nearest config names, and of the nearest project glossary; each must be sound, and
    all together (glossary.compose() raises else)."""
    config, own = project_file(path, CONFIG), project_file(path, TERMS)
    ids = parse_config(open(config, encoding="utf-8").read()) if config else []
    parts = [shown(spark, k) for k in ids]
    if own:
        parts.append(glossary.read_terms(spark, own))
    return Effective(ids, own, glossary.compose(*parts) if parts else None)


def choose_lexicon(spark: SparkSession, path: str | None = None, sha256: str | None = None, size: int | None = None, allow_starter: bool = False) -> DataFrame:
    """The lexicon of a path, else of the environment, else (only if allowed) the starter one. With a digest and a size the file
    is verified."""
    path = path or os.environ.get(LEXICON_VARIABLE)
    if path:
        return lexicon.verified(spark, path, sha256, size or 0) if sha256 else lexicon.read_entries(spark, path)
    if not allow_starter:
        raise ValueError(f"no lexicon: give a path or set {LEXICON_VARIABLE}, or allow the starter lexicon")
    return lexicon.starter(spark)
