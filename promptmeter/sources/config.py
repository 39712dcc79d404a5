"""Configuration read on the driver: manifests (a subset of TOML), fairness corpora, CI events, command-line options."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

_TRIM = " \t\r\"'"


@dataclass
class Prompt:
    path: str = ""
    prompt_id: str | None = None
    model: str | None = None
    tags: dict[str, str] = field(default_factory=dict)


@dataclass
class Policy:
    max_cost_usd: float | None = None
    warn_threshold: float = 0.8
    allowed_models: list[str] | None = None
    default_model: str | None = None
    prompts: list[Prompt] = field(default_factory=list)


def parse_list(text: str) -> list[str]:
    """Items between brackets, cut at every comma."""
    return [x for item in text.strip().strip("[]").split(",") if (x := item.strip(_TRIM))]


def parse_table(text: str) -> dict[str, str]:
    """Pairs between braces, cut at every comma; of equal keys the last counts."""
    pairs = (item.partition("=") for item in text.strip().strip("{}").split(","))
    return {k.strip(_TRIM): v.strip(_TRIM) for k, sign, v in pairs if sign and k.strip(_TRIM)}


def _float(text: str) -> float | None:
    try:
        return float(text)
    except ValueError:
        return None


def parse_manifest(text: str) -> Policy:
    """Line by line: `#` begins a comment anywhere; sections budget, policy, defaults and repeated prompts; others are ignored."""
    out, section = Policy(), ""
    for raw in text.splitlines():
        line = raw.partition("#")[0].strip()
        if line == "[[prompts]]":
            section = "prompts"
            out.prompts.append(Prompt())
        elif line.startswith("["):
            section = line.strip("[]").strip()
            section = section if section in ("budget", "policy", "defaults") else ""
        elif "=" in line and section:
            key, _, value = (x.strip() for x in line.partition("="))
            plain = value.strip(_TRIM)
            match section, key:
                case "budget", "max_cost_usd":
                    out.max_cost_usd = _float(plain)
                case "budget", "warn_threshold":
                    out.warn_threshold = 0.8 if (x := _float(plain)) is None else x
                case "policy", "allowed_models":
                    out.allowed_models = parse_list(value)
                case "defaults", "model":
                    out.default_model = plain
                case "prompts", "path" | "prompt_id" | "model":
                    setattr(out.prompts[-1], key, plain)
                case "prompts", "tags":
                    out.prompts[-1].tags |= parse_table(value)
    return out


def prompts_table(spark: SparkSession, policy: Policy) -> DataFrame:
    """The manifest's prompts with their place."""
    rows = [(k, p.path, p.prompt_id, p.model, p.tags) for k, p in enumerate(policy.prompts)]
    return spark.createDataFrame(rows, "place int, path string, prompt_id string, model string, tags map<string,string>")


def manifest_text(paths: list[tuple[str, str]], model: str = "gpt-4o") -> str:
    """A manifest of (prompt_id, path) pairs."""
    head = f'[budget]\nmax_cost_usd = 10.0\nwarn_threshold = 0.8\n\n[policy]\nallowed_models = ["{model}"]\n\n[defaults]\nmodel = "{model}"\n'
    return head + "".join(f'\n[[prompts]]\nprompt_id = "{i}"\npath = "{p}"\n' for i, p in paths)


def unique_slugs(slugs: list[str]) -> list[str]:
    """In order: a slug that is taken gets -1, -2, ... until it is free."""
    used: set[str] = set()
    out = []
    for slug in slugs:
        name, k = slug, 0
        while name in used:
            k += 1
            name = f"{slug}-{k}"
        used.add(name)
        out.append(name)
    return out


@dataclass
class Language:
    code: str
    name: str
    path: str
    mode: str = "whitespace"
    word_count: int | None = None


def parse_corpus(text: str) -> tuple[str, list[Language]]:
    """Baseline and languages of {config: {baseline_lang}, languages: {code: {name, path, mode, word_count}}}; faults raise."""
    if len(text.encode()) > 1 << 20:
        raise ValueError("corpus file too large")
    root = json.loads(text)
    if not isinstance(root, dict) or not isinstance(root.get("config"), dict):
        raise ValueError("config is missing")
    base, languages = root["config"].get("baseline_lang"), root.get("languages")
    if not isinstance(base, str):
        raise ValueError("config.baseline_lang is missing")
    if not isinstance(languages, dict):
        raise ValueError("languages is missing")
    out = []
    for code, entry in languages.items():
        if not isinstance(entry, dict) or not isinstance(entry.get("name"), str) or not isinstance(entry.get("path"), str):
            raise ValueError(f"language {code} needs name and path")
        mode, n = entry.get("mode"), entry.get("word_count")
        out.append(Language(code, entry["name"], entry["path"], mode if mode in ("whitespace", "character", "heuristic") else "whitespace", n if isinstance(n, int) else None))
    if base not in languages:
        raise ValueError("the baseline is none of the languages")
    return base, out


def parse_event(text: str) -> tuple[str, str, int]:
    """owner, repository and pull request number of a CI event."""
    root = json.loads(text)
    owner, slash, name = str(root["repository"]["full_name"]).partition("/")
    if not slash:
        raise ValueError("repository.full_name has no owner")
    pull = root.get("pull_request")
    number = pull.get("number") if isinstance(pull, dict) else root.get("number")
    if not isinstance(number, int):
        raise ValueError("no pull request number")
    return owner, name, number


def parse_options(args: list[str], env: dict[str, str]) -> dict:
    """Gate options from arguments and environment; an unknown flag raises."""
    out: dict = {"token": env.get("GITHUB_TOKEN"), "event_path": env.get("GITHUB_EVENT_PATH"), "base_ref": env.get("GITHUB_BASE_REF"), "fail_on_increase": False}
    values = {"--manifest": "manifest", "--budget": "budget", "--base": "base_ref", "--comment-threshold": "threshold"}
    at = 0
    while at < len(args):
        if args[at] == "--fail-on-increase":
            out["fail_on_increase"] = True
        elif args[at] in values and at + 1 < len(args):
            at += 1
            out[values[args[at - 1]]] = float(args[at]) if args[at - 1] in ("--budget", "--comment-threshold") else args[at]
        else:
            raise ValueError(f"unknown option {args[at]}")
        at += 1
    return out
