"""Configurations: JSON with comments and single quotes, read into a typed registry."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import SparkSession

KINDS = ("int", "double", "string", "boolean", "int_seq", "int_seq_seq", "double_seq", "json", "json_seq")


def lenient_json(text: str) -> Any:
    """JSON in which // and /* */ comments and strings in single quotes are allowed."""
    out, i, n = [], 0, len(text)
    while i < n:
        c = text[i]
        if text.startswith("//", i):
            i = text.find("\n", i) if "\n" in text[i:] else n
        elif text.startswith("/*", i):
            i = text.index("*/", i) + 2
        elif c in "\"'":
            j = i + 1
            while text[j] != c:
                j += 2 if text[j] == "\\" else 1
            body = text[i + 1 : j]
            out.append(text[i : j + 1] if c == '"' else '"' + body.replace("\\'", "'").replace('"', '\\"') + '"')
            i = j + 1
        else:
            out.append(c)
            i += 1
    return json.loads("".join(out))


def _convert(kind: str, v: Any) -> Any:
    def no(x: Any) -> Any:
        raise ValueError(f"{x!r} is no {kind}")

    def seq(f):
        return lambda x: [f(e) for e in x] if isinstance(x, list) else no(x)

    def boolean(x: Any) -> bool:
        return x if isinstance(x, bool) else x != 0 if isinstance(x, (int, float)) else x.strip() == "true" if isinstance(x, str) else no(x)

    return {
        "int": lambda x: int(float(x)),
        "double": float,
        "string": lambda x: x if isinstance(x, str) else json.dumps(x),
        "boolean": boolean,
        "int_seq": seq(lambda x: int(float(x))),
        "int_seq_seq": seq(seq(lambda x: int(float(x)))),
        "double_seq": seq(float),
        "json": lambda x: x,
        "json_seq": seq(lambda x: x),
    }[kind](v)


@dataclass(frozen=True)
class Entry:
    kind: str
    required: bool = True
    default: Any = None


@dataclass
class Registry:
    """Declared entries, then their values. A default counts only for an entry that isn't required."""

    entries: dict[str, Entry] = field(default_factory=dict)
    values: dict[str, Any] = field(default_factory=dict)

    def add(self, tag: str, kind: str, *, required: bool = True, default: Any = None) -> Registry:
        if kind not in KINDS:
            raise ValueError(f"unknown kind {kind}")
        if tag in self.entries:
            raise ValueError(f"{tag} is declared twice")
        self.entries[tag] = Entry(kind, required, default)
        return self

    def parse(self, text: str) -> Registry:
        found = lenient_json(text)
        for tag, e in self.entries.items():
            if found.get(tag) is not None:
                self.values[tag] = _convert(e.kind, found[tag])
            elif e.required:
                raise ValueError(f"{tag} is required")
            else:
                self.values[tag] = e.default
        return self

    def get(self, tag: str, kind: str) -> Any:
        """A required value of a kind."""
        value = self.option(tag, kind)
        if value is None:
            raise KeyError(f"{tag} has no value")
        return value

    def option(self, tag: str, kind: str) -> Any:
        if tag not in self.entries or self.entries[tag].kind != kind:
            raise KeyError(f"{tag} isn't declared as {kind}")
        return self.values.get(tag)


def read_text(spark: SparkSession, path: str) -> str:
    """A small file's text, from any store that Spark reads."""
    return "\n".join(r["value"] for r in spark.read.text(path).collect())


def numbers(spark: SparkSession, value: Any) -> list[float] | None:
    """An array of numbers, or the file that holds one (as JSON); None stays None."""
    if isinstance(value, str):
        value = lenient_json(read_text(spark, value))
    if value is not None and not isinstance(value, list):
        raise ValueError(f"{value!r} is no array of numbers")
    return None if value is None else [float(v) for v in value]


def _declare(required: dict[str, str], optional: dict[str, tuple[str, Any]]) -> Registry:
    out = Registry()
    for tag, kind in required.items():
        out.add(tag, kind)
    for tag, (kind, default) in optional.items():
        out.add(tag, kind, required=False, default=default)
    return out


def build_config() -> Registry:
    return _declare(
        {"featureCount": "int", "labels": "double_seq", "countTableConfig": "json", "countDataFile": "string", "countTableFile": "string"},
        {
            "percentilesFile": ("string", None), "featureCombinations": ("int_seq_seq", []), "dependentFeatures": ("int_seq_seq", []), "featurizerName": ("string", "featurizer"), "name": ("string", None),
            "isBackingNoise": ("boolean", False), "noiseLaplaceB": ("double", 0.0), "sumNNoiseDraws": ("int", 1), "tableSpecificNumberOfQueries": ("double_seq", None),
            "dpNoiseShareWeights": ("json", None), "featureImportanceWeights": ("json", None), "perFeatureCountTableConfig": ("json_seq", None), "windowSize": ("int", None), "useWeights": ("boolean", False), "noiseSeed": ("int", None),
        },
    )


def hot_build_config() -> Registry:
    return _declare(
        {"featureCount": "int", "labels": "double_seq", "featureCombinations": "int_seq_seq", "hotWindowSize": "int", "countTableSize": "int", "countDataFile": "string", "countTableFile": "string"},
        {"percentilesFile": ("string", None), "countTableCount": ("int", None), "windowNoiseLaplaceB": ("double", 0.0), "noiseSeed": ("int", None), "name": ("string", None)},
    )


#: What a featurized line has.
_LINE = {
    "percentilesFile": ("string", None), "removeFirstLabel": ("boolean", False), "keepOriginalFeatures": ("boolean", False), "originalFeaturesToKeep": ("int_seq", []), "featurizeWithCounts": ("boolean", False),
    "featurizeWithTotalCounts": ("boolean", False), "featurizeWithProbabilities": ("boolean", True), "defaultProbabilityTotalCriterion": ("boolean", True), "defaultProbabilityVarianceCriterion": ("boolean", False),
    "defaultProbabilityMultiple": ("double", 1.0), "decimalDigits": ("int", 4),
}


def transform_config() -> Registry:
    return _declare(
        {"featureCount": "int", "countTableFile": "string", "transformDataFilePath": "string", "outDataFile": "string"},
        _LINE | {"updateCountFile": ("string", None), "addBackingTableNoise": ("boolean", False), "windowSize": ("int", None)},
    )


def hot_transform_config() -> Registry:
    return _declare({"featureCount": "int", "countTableFile": "string", "outDataFile": "string"}, _LINE | {"transformDataFilePath": ("string", None)})


def discretize_config() -> Registry:
    return _declare({"featureCount": "int", "percentilesFile": "string", "dataFile": "string", "outDataFile": "string"}, {})


def noise_weights_config() -> Registry:
    return _declare(
        {"featureCount": "int", "percentile": "double", "countTableFile": "string", "transformDataFilePath": "string", "outDataFile": "string", "epsilonDP": "double"},
        {"percentilesFile": ("string", None), "windowSize": ("int", None), "multiGroups": ("boolean", False)},
    )


def prepare_config() -> Registry:
    """Tab-separated records; sampleFraction is the share of them that percentiles are computed over."""
    return _declare({"featureCount": "int", "dataFile": "string"}, {"outDataFile": ("string", None), "percentilesFile": ("string", None), "percentileCount": ("int", 100), "sampleFraction": ("double", 0.01), "sampleSeed": ("int", 1)})


def prepare_ratings_config() -> Registry:
    return _declare({"ratingsFile": "string", "moviesFile": "string", "outDataFile": "string", "countProportion": "double", "trainProportion": "double"}, {"randomSampling": ("boolean", False), "labelType": ("string", "raw"), "sampleSeed": ("int", 1)})


def prepare_labels_config() -> Registry:
    return _declare({"dataFile": "string", "outDataFile": "string"}, {})
