"""Detection rules: YAML documents compiled once to Spark columns.

Three kinds are read: single-event rules (logsource, selections, condition), threshold rules (match, group,
window) and correlation rules (a count over one named single-event rule). What cannot be evaluated is refused
with its reason, never half-loaded.
"""

from __future__ import annotations

import base64
import hashlib
import json
import pickle
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from fnmatch import fnmatchcase
from functools import cached_property, partial, reduce
from typing import Any, NamedTuple

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casewright.functions.scalars import RENAMED_TACTICS, TACTICS, duration_ms
from casewright.operators import predicates as P
from casewright.operators.scopes import Scope, scope_for, scope_named
from casewright.session import cut_lineage

try:
    import yaml
except ImportError:  # rule files can then be JSON, which YAML includes
    yaml = None

# --- Fixed values -----------------------------------------------------------------------------------------------
LEVEL_SEVERITY = {"informational": 1, "low": 2, "medium": 3, "high": 4, "critical": 5}
MAX_WINDOW_MS = 24 * 3_600_000
MIN_THRESHOLD, MAX_THRESHOLD = 2, 10_000
MAX_GROUP_FIELDS = 5
ABSENT_TEXT = "-"
DASHES = ("-", "/", "–", "—", "―")
RULE_ENDINGS = (".yml", ".yaml", ".json")
MOST_LISTING, FILES_PER_TASK, BYTES_PER_BATCH = 1024, 512, 4 << 20
# ------------------------------------------------------------------------------------------------------------

RULES_SCHEMA = (
    "rule_id string, title string, description string, level string, severity_id int, rule_type string, "
    "logsource string, techniques array<string>, tactics array<string>, version string, path string, "
    "author string, source_url string, threshold int, window_ms bigint"
)


class RuleRefused(ValueError):
    """A rule that cannot be evaluated as written."""


@dataclass(frozen=True)
class Test:
    """A predicate written down: the function of ``predicates`` and what it takes. Tasks make them, the driver columns."""

    name: str
    args: tuple
    options: tuple = ()

    def column(self) -> Any:
        if self.name == "in_scope":
            return scope_named(*self.args).where()
        return getattr(P, self.name)(*[_built(a) for a in self.args], **dict(self.options))


def _built(value: Any) -> Any:
    if isinstance(value, tuple):
        return [_built(v) for v in value]
    return value.column() if isinstance(value, Test) else value


class _Written:
    def __getattr__(self, name: str):
        return lambda *args, **options: Test(name, tuple(tuple(a) if isinstance(a, list) else a for a in args), tuple(options.items()))


WRITTEN = _Written()


@dataclass(frozen=True)
class Rule:
    id: str
    title: str
    level: str
    techniques: tuple[str, ...]
    tactics: tuple[str, ...]
    version: str
    path: str
    test: Test
    description: str = ""
    author: str = ""
    source_url: str | None = None
    name: str | None = None
    scope: str | None = None
    # Only threshold rules have these.
    group_by: tuple[str, ...] = ()
    threshold: int = 0
    window_ms: int = 0
    count_distinct: str | None = None

    @property
    def predicate(self) -> Column:
        return self.test.column()

    @property
    def is_threshold(self) -> bool:
        return bool(self.group_by)

    @property
    def severity_id(self) -> int:
        return LEVEL_SEVERITY[self.level]

    def as_row(self) -> tuple:
        return (
            self.id,
            self.title,
            self.description,
            self.level,
            self.severity_id,
            "threshold" if self.is_threshold else "single",
            self.scope,
            list(self.techniques),
            list(self.tactics),
            self.version,
            self.path,
            self.author,
            self.source_url,
            self.threshold or None,
            self.window_ms or None,
        )


class RuleSet(NamedTuple):
    rules: tuple[Rule, ...]
    refused: tuple[tuple[str, str], ...]  # (path, reason)

    @property
    def single(self) -> list[Rule]:
        return [r for r in self.rules if not r.is_threshold]

    @property
    def threshold(self) -> list[Rule]:
        return [r for r in self.rules if r.is_threshold]

    def to_dataframe(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([r.as_row() for r in self.rules], RULES_SCHEMA)

    def refused_dataframe(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.refused), "path string, reason string")


def attack_from_tags(tags: list[str]) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """Techniques and tactics named by ``attack.*`` tags, in order, once each."""
    names = [str(tag).strip().lower().partition("attack.")[2] for tag in tags]
    techniques = [n.upper() for n in names if re.fullmatch(r"t\d{4}(\.\d{3})?", n)]
    plain = [n.replace("-", "_") for n in names]
    tactics = [t for t in (RENAMED_TACTICS.get(n, n) for n in plain) if t in TACTICS]
    return tuple(dict.fromkeys(techniques)), tuple(dict.fromkeys(tactics))


# ------------------------------------------------------------------------------------------- single-event rules
def _spellings(value: Any, modifiers: list[str]) -> list[Any]:
    """The values a modifier chain turns one value into."""
    values = [value]
    for modifier in modifiers:
        if modifier in ("wide", "utf16le", "utf16", "utf16be"):
            coding = {"wide": "utf-16-le", "utf16le": "utf-16-le", "utf16": "utf-16", "utf16be": "utf-16-be"}[modifier]
            values = [str(v).encode(coding) for v in values]
        elif modifier == "base64":
            values = [base64.b64encode(_bytes(v)).decode() for v in values]
        elif modifier == "base64offset":
            values = [_shifted_base64(_bytes(v), shift) for v in values for shift in range(3)]
        elif modifier == "windash":
            values = [
                v2
                for v in values
                for v2 in dict.fromkeys(re.sub(r"\B[-/]\b", lambda _, d=d: d, str(v)) for d in DASHES)
            ]
    return values


def _bytes(value: Any) -> bytes:
    return value if isinstance(value, bytes) else str(value).encode()


def _shifted_base64(raw: bytes, shift: int) -> str:
    """The part of the encoding that does not depend on the bytes around ``raw`` when it starts at ``shift``."""
    encoded = base64.b64encode(b" " * shift + raw).decode()
    return encoded[(0, 2, 3)[shift] : len(encoded) - (0, 3, 2)[(len(raw) + shift) % 3]]


_TRANSFORMS = {"wide", "utf16", "utf16le", "utf16be", "base64", "base64offset", "windash"}
_SHAPES = {"contains": (True, True), "startswith": (False, True), "endswith": (True, False)}
_COMPARISONS = {"lt", "lte", "gt", "gte", "neq"}
_PLAIN = {"all", "cased", "re", "i", "m", "s", "cidr", "exists"}


def _field_test(scope: Scope, field: str, modifiers: list[str], value: Any) -> Test:
    paths = scope.fields.get(field)
    if paths is None:
        raise RuleRefused(f"field '{field}' is not mapped for logsource {scope.name}")
    if value is None:
        return WRITTEN.field_is_null(paths)
    if "exists" in modifiers:
        return WRITTEN.field_exists(paths, bool(value))
    if "re" in modifiers:
        return WRITTEN.field_match(paths, WRITTEN.regex(str(value), "".join(f for f in "ims" if f in modifiers)))
    if "cidr" in modifiers:
        return WRITTEN.field_match(paths, WRITTEN.cidr(str(value)))
    comparison = next((m for m in modifiers if m in _COMPARISONS), None)
    if comparison:
        try:
            number = float(value)
        except (TypeError, ValueError):
            raise RuleRefused(f"'{comparison}' needs a number, not {value!r}") from None
        return WRITTEN.field_match(paths, WRITTEN.number_compare(comparison, number))
    if isinstance(value, bool):
        return WRITTEN.field_match(paths, WRITTEN.bool_equals(value))
    shape = next((m for m in modifiers if m in _SHAPES), None)
    if isinstance(value, (int, float)) and shape is None and not _TRANSFORMS & set(modifiers):
        return WRITTEN.field_match(paths, WRITTEN.number_equals(value))
    start, end = _SHAPES.get(shape, (False, False))
    cased = "cased" in modifiers
    tests = [
        WRITTEN.field_match(paths, WRITTEN.glob(str(v), cased=cased, open_start=start, open_end=end))
        for v in _spellings(value, modifiers)
    ]
    if shape is None and value == ABSENT_TEXT:
        # Logs write '-' where nothing was recorded and normalisation drops it.
        tests.append(WRITTEN.field_is_null(paths))
    return WRITTEN.any_of(tests)


def _keyword_test(scope: Scope, value: Any) -> Test:
    if not scope.keyword_paths:
        raise RuleRefused(f"keyword searches are not supported for logsource {scope.name}")
    text = str(value)
    if isinstance(value, str) and re.search(r"(?<!\\)[*?]", text):
        return WRITTEN.field_match(scope.keyword_paths, WRITTEN.glob(text))
    return WRITTEN.field_match(scope.keyword_paths, WRITTEN.glob(text, open_start=True, open_end=True))


def _selection(scope: Scope, body: Any) -> Test:
    """A map is all-of its fields, a list any-of its items, a bare value a keyword."""
    if isinstance(body, dict):
        return WRITTEN.all_of([_field_item(scope, key, value) for key, value in body.items()])
    if isinstance(body, list):
        return WRITTEN.any_of([_selection(scope, item) for item in body])
    return _keyword_test(scope, body)


def _field_item(scope: Scope, key: str, value: Any) -> Test:
    field, *modifiers = str(key).split("|")
    unknown = set(modifiers) - _TRANSFORMS - set(_SHAPES) - _COMPARISONS - _PLAIN
    if unknown:
        raise RuleRefused(f"unsupported modifier '{sorted(unknown)[0]}'")
    values = value if isinstance(value, list) else [value]
    if not field:
        tests = [_keyword_test(scope, v) for v in values]
    else:
        tests = [_field_test(scope, field, modifiers, v) for v in values]
    return WRITTEN.all_of(tests) if "all" in modifiers else WRITTEN.any_of(tests)


_CONDITION_WORD = re.compile(r"[()]|[^\s()]+")


def _condition(text: str, selections: dict[str, Test]) -> Test:
    """A condition over selection names, which may hold any character but white space and brackets.

    ``not`` binds tighter than ``and``, ``and`` tighter than ``or``; ``1 of``, ``any of`` and ``all of`` take
    ``them`` (names that do not begin with an underscore) or a name with ``*``.
    """
    words = _CONDITION_WORD.findall(str(text))[::-1]  # the next word is the last

    def next_is(*wanted: str) -> bool:
        return bool(words) and words[-1].lower() in wanted

    def taken() -> str:
        if not words:
            raise RuleRefused(f"unsupported condition '{text}'")
        return words.pop()

    def either() -> Test:
        parts = [both()]
        while next_is("or"):
            taken()
            parts.append(both())
        return WRITTEN.any_of(parts) if len(parts) > 1 else parts[0]

    def both() -> Test:
        parts = [single()]
        while next_is("and"):
            taken()
            parts.append(single())
        return WRITTEN.all_of(parts) if len(parts) > 1 else parts[0]

    def single() -> Test:
        word = taken()
        lowered = word.lower()
        if lowered == "not":
            return WRITTEN.negate(single())
        if word == "(":
            inner = either()
            if taken() != ")":
                raise RuleRefused(f"unsupported condition '{text}'")
            return inner
        if lowered in ("1", "any", "all") and next_is("of"):
            taken()
            return several(lowered, word, taken())
        if word in selections:
            return selections[word]
        if word == ")" or lowered in ("and", "or", "of") or "|" in word:
            raise RuleRefused(f"unsupported condition '{text}'")
        raise RuleRefused(f"condition names '{word}', which is not a selection")

    def several(amount: str, word: str, pattern: str) -> Test:
        them = pattern.lower() == "them"
        chosen = [
            column
            for name, column in selections.items()
            if (not name.startswith("_") if them else fnmatchcase(name, pattern))
        ]
        if not chosen:
            raise RuleRefused(f"'{word} of {pattern}' names no selection")
        return WRITTEN.all_of(chosen) if amount == "all" else WRITTEN.any_of(chosen)

    found = either()
    if words:
        raise RuleRefused(f"unsupported condition '{text}'")
    return found


def _meta(document: dict, text: str, path: str) -> dict[str, Any]:
    if not document.get("id"):
        raise RuleRefused("a rule must have an id")
    level = str(document.get("level", "")).lower()
    if level not in LEVEL_SEVERITY:
        raise RuleRefused("a rule must have a level from informational to critical")
    techniques, tactics = attack_from_tags(document.get("tags") or [])
    return {
        "id": str(document["id"]),
        "title": str(document.get("title") or ""),
        "description": str(document.get("description") or ""),
        "level": level,
        "techniques": techniques,
        "tactics": tactics,
        "version": hashlib.sha256(text.encode()).hexdigest(),
        "path": path,
        "author": str(document.get("author") or "")[:255],
    }


def compile_rule(document: dict, *, text: str = "", path: str = "") -> Rule:
    """A single-event rule; raises ``RuleRefused`` with the reason when it cannot be evaluated."""
    meta = _meta(document, text, path)
    source = document.get("logsource") or {}
    scope = scope_for(source.get("category"), source.get("product"), source.get("service"))
    if scope is None:
        listed = ", ".join(f"{k}={source.get(k)}" for k in ("category", "product", "service") if source.get(k))
        raise RuleRefused(f"unsupported logsource {listed or '(none)'}")
    detection = dict(document.get("detection") or {})
    conditions = detection.pop("condition", None)
    detection.pop("timeframe", None)
    if not conditions or not detection:
        raise RuleRefused("a rule needs selections and a condition")
    selections = {str(name): _selection(scope, body) for name, body in detection.items()}
    listed = conditions if isinstance(conditions, list) else [conditions]
    matched = WRITTEN.any_of([_condition(c, selections) for c in listed])
    name = document.get("name")
    return Rule(**meta, test=matched, scope=scope.name, name=str(name) if name else None)


# ---------------------------------------------------------------------------------------------- threshold rules
def _match_test(match: dict) -> Test:
    """``field: value``, ``field: [a, b]`` (any of) or ``field|external: true``."""
    tests = []
    for key, expected in match.items():
        path, _, operator = str(key).partition("|")
        known = operator == "external" and expected is True or not operator and isinstance(expected, (list, str, int, float, bool)) and expected != []
        if known:
            P.located(path)
        if operator == "external":
            if expected is not True:
                raise RuleRefused(f"'{key}' only accepts true")
            tests.append(WRITTEN.field_match((path,), WRITTEN.external_ip()))
        elif operator:
            raise RuleRefused(f"unsupported match operator '|{operator}'")
        elif isinstance(expected, (list, str, int, float, bool)) and expected != []:
            options = expected if isinstance(expected, list) else [expected]
            tests.append(WRITTEN.any_of([WRITTEN.field_match((path,), WRITTEN.equals(option)) for option in options]))
        else:
            raise RuleRefused(f"'{key}' must be a value or a list of values")
    return WRITTEN.all_of(tests)


def _window(text: Any) -> int:
    try:
        window = duration_ms(str(text))
    except ValueError as error:
        raise RuleRefused(str(error)) from None
    if not 0 < window <= MAX_WINDOW_MS:
        raise RuleRefused("a window is longer than zero and at most 24h")
    return window


def compile_threshold(document: dict, *, text: str = "", path: str = "") -> Rule:
    """A threshold rule: enough matching events, or distinct values, for one group within a window."""
    meta = _meta(document, text, path)
    group_by = tuple(document.get("group_by") or ())
    threshold = document.get("threshold")
    if not 1 <= len(group_by) <= MAX_GROUP_FIELDS:
        raise RuleRefused(f"group_by names 1 to {MAX_GROUP_FIELDS} fields")
    if not isinstance(threshold, int) or not MIN_THRESHOLD <= threshold <= MAX_THRESHOLD:
        raise RuleRefused(f"threshold must be between {MIN_THRESHOLD} and {MAX_THRESHOLD}")
    if not document.get("match"):
        raise RuleRefused("a threshold rule needs a match")
    distinct = document.get("count_distinct")
    try:
        for field in (*group_by, *([distinct] if distinct else [])):
            P.located(field)
        matched = _match_test(document["match"])
    except P.UnknownPath as error:
        raise RuleRefused(str(error)) from None
    return Rule(
        **meta,
        test=matched,
        group_by=group_by,
        threshold=threshold,
        window_ms=_window(document.get("window")),
        count_distinct=distinct,
    )


def compile_correlation(document: dict, base_rules: dict[str, Rule], *, text: str = "", path: str = "") -> Rule:
    """``event_count`` or ``value_count`` over one named rule, as a threshold rule."""
    meta = _meta(document, text, path)
    spec = document["correlation"]
    kind = str(spec.get("type"))
    if kind not in ("event_count", "value_count"):
        raise RuleRefused(f"unsupported correlation type '{kind}'")
    named = spec.get("rules")
    named = [named] if isinstance(named, str) else list(named or [])
    if len(named) != 1:
        raise RuleRefused(f"a correlation counts one base rule; this names {len(named)}")
    base = base_rules.get(named[0])
    if base is None:
        raise RuleRefused(f"no rule named '{named[0]}'")
    condition = spec.get("condition") or {}
    operators = [k for k in condition if k != "field"]
    if operators != ["gte"]:
        raise RuleRefused("only 'gte' conditions are supported")
    count = condition["gte"]
    if not isinstance(count, int) or count < MIN_THRESHOLD:
        raise RuleRefused("the condition count must be 2 or more")
    fields = scope_named(base.scope).fields

    def path_of(field: str) -> str:
        if field not in fields:
            raise RuleRefused(f"field '{field}' is not mapped for logsource {base.scope}")
        return fields[field][0]

    group_by = spec.get("group-by")
    group_by = [group_by] if isinstance(group_by, str) else list(group_by or [])
    if not group_by:
        raise RuleRefused("a correlation must group by at least one field")
    counted = condition.get("field")
    if kind == "value_count" and not counted:
        raise RuleRefused("a value_count condition must name the field it counts")
    return replace(
        base,
        **(meta | {"title": meta["title"] or base.title, "description": meta["description"] or base.description}),
        test=WRITTEN.all_of([WRITTEN.in_scope(base.scope), base.test]),
        scope=None,
        name=None,
        group_by=tuple(path_of(f) for f in group_by),
        threshold=count,
        window_ms=_window(spec.get("timespan")),
        count_distinct=path_of(counted) if kind == "value_count" else None,
    )


# --------------------------------------------------------------------------------------------------- rule sets
def _documents(text: str) -> list[dict]:
    if yaml is not None:
        parsed = list(yaml.load_all(text, Loader=getattr(yaml, "CSafeLoader", yaml.SafeLoader)))
    else:
        parsed = json.loads(text)
        parsed = parsed if isinstance(parsed, list) else [parsed]
    return [d for d in parsed if isinstance(d, dict)]


def _entries(path: str, text: str) -> list[tuple[str, dict, str]]:
    """Where each document of a rule file stands, the document and its own text."""
    try:
        documents = _documents(text)
    except ValueError as error:
        raise RuleRefused(f"not valid YAML: {str(error).splitlines()[0]}") from None
    except Exception as error:  # yaml's own errors share no standard base class
        raise RuleRefused(f"not valid YAML: {type(error).__name__}") from None
    if len(documents) == 1:
        return [(path, documents[0], text)]
    return [(f"{path}#{n}", d, json.dumps(d, sort_keys=True, default=str)) for n, d in enumerate(documents, start=1)]


def _counted(document: dict) -> list[str]:
    """The names of the rules that a correlation counts."""
    listed = document["correlation"].get("rules")
    return [listed] if isinstance(listed, str) else list(listed or ())


def compile_rules(files: list[tuple[str, str]], source_urls: dict[str, str] | None = None) -> RuleSet:
    """Compile ``(path, text)`` rule files. A correlation's base rule supports it and does not fire by itself."""
    refused: list[tuple[str, str]] = []
    entries: list[tuple[str, dict, str]] = []
    for path, text in files:
        try:
            entries += _entries(path, text)
        except RuleRefused as error:
            refused.append((path, str(error)))

    urls = source_urls or {}
    compiled: list[Rule] = []
    seen: set[str] = set()
    named: dict[str, Rule] = {}
    correlations = [e for e in entries if "correlation" in e[1]]
    counted = set()
    for _, document, _ in correlations:
        counted |= set(_counted(document))

    def keep(where: str, build) -> Rule | None:
        try:
            rule = build()
        except RuleRefused as error:
            refused.append((where, str(error)))
            return None
        if rule.id in seen:
            refused.append((where, f"duplicate rule id {rule.id}"))
            return None
        seen.add(rule.id)
        return replace(rule, source_url=urls.get(where.partition("#")[0]))

    for where, document, own in entries:
        if "correlation" in document:
            continue
        build = compile_threshold if "match" in document else compile_rule
        rule = keep(where, lambda b=build, d=document, o=own, w=where: b(d, text=o, path=w))
        if rule is None:
            continue
        if rule.name:
            named[rule.name] = rule
        if rule.name not in counted or rule.name is None:
            compiled.append(rule)
    for where, document, own in correlations:
        rule = keep(where, lambda d=document, o=own, w=where: compile_correlation(d, named, text=o, path=w))
        if rule is not None:
            compiled.append(rule)
    return RuleSet(tuple(compiled), tuple(refused))


def _one_slash(uri: Column | str) -> Column:
    """File URIs are written with one or three slashes; both mean the same."""
    return F.regexp_replace(uri if isinstance(uri, Column) else F.lit(uri), r"^([A-Za-z][A-Za-z0-9+.-]*):/{3}", "$1:/")


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder and the folder's path there, for a task."""
    return (fs.LocalFileSystem(), uri.removeprefix("file:")) if uri.startswith("file:") else fs.FileSystem.from_uri(uri)


def _tasks_reach(uri: str) -> bool:
    try:
        system, folder = _store(uri)
        return system.get_file_info(folder).type == fs.FileType.Directory
    except (OSError, ValueError, pa.ArrowException):
        return False


def _hidden(name: str, folder: bool) -> bool:
    """What Spark's reader passes over as well."""
    kept = "=" in name or folder and name.startswith(("_metadata", "_common_metadata"))
    return name.startswith(".") or name.startswith("_") and not kept or name.endswith("._COPYING_")


_LISTED = "path string, folder boolean"


def _list_folders(root: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The folders and rule files in each folder, their paths counted from the root."""
    system, top = _store(root)
    for batch in batches:
        for path in batch.column("path").to_pylist():
            found = []
            for info in system.get_file_info(fs.FileSelector(f"{top}/{path}".rstrip("/"))):
                folder = info.type == fs.FileType.Directory
                wanted = folder or info.size != 0 and info.base_name.endswith(RULE_ENDINGS)
                if wanted and not _hidden(info.base_name, folder):
                    found.append((f"{path}/{info.base_name}".lstrip("/"), folder))
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.string()), pa.array([f for _, f in found], pa.bool_())], ["path", "folder"])


def _read_texts(root: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    system, top = _store(root)

    def of(rows: list[tuple[str, bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows], pa.string()), pa.array([t for _, t in rows], pa.binary())], ["path", "text"])

    for batch in batches:
        rows, held = [], 0
        for path in batch.column("path").to_pylist():
            with system.open_input_stream(f"{top}/{path}", compression=None) as file:
                rows.append((path, file.read()))
            held += len(rows[-1][1])
            if held >= BYTES_PER_BATCH:
                yield of(rows)
                rows, held = [], 0
        yield of(rows)


def _listed_by_tasks(spark: SparkSession, root: str) -> DataFrame:
    """The paths of all rule files, folder by folder and level by level; the driver learns only how many there are."""
    levels, folders = [], spark.createDataFrame([("", True)], _LISTED)
    while count := folders.count():
        spread = folders.repartition(min(count, MOST_LISTING))
        levels.append(cut_lineage(spread.mapInArrow(partial(_list_folders, root), _LISTED)))
        folders = levels[-1].filter("folder")
    return reduce(DataFrame.unionByName, levels).filter("NOT folder").select("path")


def rule_files(spark: SparkSession, path: str, chosen: Column | str = "true") -> DataFrame:
    """``(path, text, version)`` of every rule file under ``path`` whose path, counted from there, is chosen.

    Folders are listed and files read by tasks; Spark's reader would hold every file at the driver. It still reads what
    is a single file or lies in a store that only Spark reaches.
    """
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    uri = system.makeQualified(folder).toUri()
    place = f"file:{uri.getPath()}" if uri.getScheme() == "file" else uri.toString()
    if _tasks_reach(place):
        paths = _listed_by_tasks(spark, place).filter(chosen)
        spread = paths.repartition(paths.count() // FILES_PER_TASK + 1)
        read = spread.mapInArrow(partial(_read_texts, place), "path string, text binary").select("path", F.col("text").cast("string").alias("text"))
        return read.select("path", "text", F.sha2("text", 256).alias("version"))
    root = _one_slash(uri.toString().rstrip("/"))
    files = (
        spark.read.option("recursiveFileLookup", "true")
        .option("pathGlobFilter", f"*{{{','.join(RULE_ENDINGS)}}}")
        .text(path, wholetext=True)
        .select(_one_slash(F.col("_metadata.file_path")).alias("file"), F.col("value").alias("text"))
    )
    below = F.substr("file", F.length(root) + 2)
    inside = F.when(F.startswith(F.col("file"), F.concat(root, F.lit("/"))), below).otherwise(
        F.substring_index("file", "/", -1)  # the path is a file itself
    )
    plain = F.url_decode(F.replace(inside, F.lit("+"), F.lit("%2B")))
    return files.select(plain.alias("path"), "text", F.sha2("text", 256).alias("version")).filter(chosen)


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows that a join deals out, never broadcast: one for each rule, whose number Spark's estimate does not know."""
    return rows.hint("shuffle_merge")


_READ = (
    "stage int, file string, at int, path string, rule_id string, name string, base string, counted array<string>, "
    "reason string, document binary, rule binary"
)
_PLACE = ("stage", "brought_in", "file", "at")
#: Stages of reading a directory: refusals are listed, and rules of one id kept, in this order.
MANIFESTS, UNREADABLE, RULES, CORRELATIONS = range(4)


def _compiled(build: Callable[[], Rule]) -> dict:
    try:
        rule = build()
    except RuleRefused as error:
        return {"reason": str(error)}
    return {"rule_id": rule.id, "name": rule.name, "rule": pickle.dumps(rule)}


def _read_file(file: str, text: str) -> Iterator[dict]:
    """A row for each document of a rule file; correlations are compiled when the rules they count are known."""
    try:
        entries = _entries(file, text)
    except RuleRefused as error:
        yield {"stage": UNREADABLE, "at": 0, "path": file, "reason": str(error)}
        return
    for at, (where, document, own) in enumerate(entries):
        row = {"at": at, "path": where}
        if "correlation" in document:
            counted = [n for n in _counted(document) if isinstance(n, str)]
            base = counted[0] if len(counted) == 1 else None
            yield row | {"stage": CORRELATIONS, "base": base, "counted": counted, "document": pickle.dumps((document, own))}
        else:
            build = compile_threshold if "match" in document else compile_rule
            yield row | {"stage": RULES} | _compiled(lambda: build(document, text=own, path=where))  # noqa: B023


def _table(rows: list[dict], like: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([{name: row.get(name) for name in like.names} for row in rows], like)


def _arrow(schema: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "array<string>": pa.list_(pa.string())}
    return pa.schema([(name, kinds[kind]) for name, kind in (field.split() for field in schema.split(", "))])


def _read_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    like = _arrow(_READ)
    for batch in batches:
        for file, text in zip(*[batch.column(c).to_pylist() for c in ("path", "text")], strict=True):
            yield _table([row | {"file": file} for row in _read_file(file, text)], like)


def _read_manifests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The files that manifests name and where each came from; a manifest that cannot be read has a reason."""
    like = _arrow(_URLS)
    for batch in batches:
        for path, text in zip(*[batch.column(c).to_pylist() for c in ("path", "text")], strict=True):
            folder = path.rpartition("/")[0]
            try:
                manifest = dict(json.loads(text))
            except (ValueError, TypeError):
                yield _table([{"manifest": path, "reason": "not a valid manifest"}], like)
                continue
            base = str(manifest.get("rule_base_url", "")).rstrip("/")
            rows = [{"manifest": path, "folder": folder}]
            for name, origin in dict(manifest.get("files") or {}).items():
                rows.append({"manifest": path, "file": f"{folder}/{name}".lstrip("/"), "url": f"{base}/{origin}"})
            yield _table(rows, like)


_URLS = "manifest string, folder string, file string, url string, reason string"


def _compile_correlations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    like = _arrow("brought_in int, " + _READ)
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            document, own = pickle.loads(row["document"])
            known = {row["base"]: pickle.loads(row["base_rule"])} if row["base_rule"] else {}
            rows.append(row | _compiled(lambda: compile_correlation(document, known, text=own, path=row["path"])))  # noqa: B023
        yield _table(rows, like)


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The columns of ``RULES_SCHEMA`` beside each compiled rule."""
    names = [field.split()[0] for field in RULES_SCHEMA.split(", ")]
    for batch in batches:
        rows = []
        for rule, url in zip(*[batch.column(c).to_pylist() for c in ("rule", "url")], strict=True):
            found = replace(pickle.loads(rule), source_url=url)
            rows.append(dict(zip(names, found.as_row(), strict=True)) | {"rule": pickle.dumps(found)})
        described = pa.RecordBatch.from_pylist(rows, _RULES_ARROW)
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(c) for c in _PLACE], *described.columns], [*[f"_{c}" for c in _PLACE], *described.schema.names]
        )


_LISTS = {"techniques", "tactics"}
_NUMBERS = {"severity_id": pa.int32(), "threshold": pa.int32(), "window_ms": pa.int64()}
_RULES_ARROW = pa.schema(
    [
        (name, pa.list_(pa.string()) if name in _LISTS else _NUMBERS.get(name, pa.string()))
        for name in (field.split()[0] for field in RULES_SCHEMA.split(", "))
    ]
    + [("rule", pa.binary())]
)


@dataclass(frozen=True)
class LoadedRules:
    """The rules of a directory as tables; the driver holds a rule only where one is asked for."""

    table: DataFrame  # the columns of ``RULES_SCHEMA``, each rule, and its place
    refusals: DataFrame  # path, reason, place

    def to_dataframe(self, spark: SparkSession | None = None) -> DataFrame:
        return self.table.drop("rule", *[f"_{c}" for c in _PLACE])

    def refused_dataframe(self, spark: SparkSession | None = None) -> DataFrame:
        return self.refusals.select("path", "reason")

    def chosen(self, condition: Column | str, most: int | None = None) -> list[Rule]:
        """The rules whose columns fulfil the condition, in order, to run them."""
        found = self.table.filter(condition).orderBy(*[f"_{c}" for c in _PLACE])
        found = found if most is None else found.limit(most)
        return [pickle.loads(row.rule) for row in found.select("rule").toLocalIterator()]

    @cached_property
    def rules(self) -> tuple[Rule, ...]:
        return tuple(self.chosen("true"))

    @cached_property
    def refused(self) -> tuple[tuple[str, str], ...]:
        return tuple((r.path, r.reason) for r in self.refusals.orderBy(*_PLACE).collect())

    @cached_property
    def single(self) -> list[Rule]:
        return self.chosen("rule_type = 'single'")

    @cached_property
    def threshold(self) -> list[Rule]:
        return self.chosen("rule_type = 'threshold'")


def _first_of_id(rows: DataFrame) -> DataFrame:
    """The rows with ``first``: whether no row before has the rule's id."""
    ids = rows.groupBy("rule_id").agg(F.min(F.struct(*_PLACE)).alias("_first"))
    return _dealt(rows).join(ids.withColumnRenamed("rule_id", "_id"), F.col("rule_id") == F.col("_id")).drop("_id").withColumn(
        "first", F.struct(*_PLACE) == F.col("_first")
    ).drop("_first")


def load_rules(spark: SparkSession, path: str) -> LoadedRules:
    """Read and compile a rule directory: every file, of any length and at any depth.

    A ``MANIFEST.json`` says where the rules of its folder, and of the folders in it, came from. Rules without one are
    the user's own and come first, so that of two rules with one id the own one stays. Files are read and compiled in
    tasks; ids and the rules that correlations count are found by joins.
    """
    manifest = F.substring_index("path", "/", -1) == "MANIFEST.json"
    urls = cut_lineage(rule_files(spark, path, manifest).select("path", "text").mapInArrow(_read_manifests, _URLS))
    folders = [r.folder for r in urls.filter("folder is not null").select("folder").collect()]  # one a manifest
    inside = [F.lit(True) if not f else F.startswith(F.col("file"), F.lit(f"{f}/")) for f in folders]
    brought_in = F.greatest(F.lit(0), F.lit(0), *[i.cast("int") for i in inside])
    read = rule_files(spark, path, ~manifest).select("path", "text").mapInArrow(_read_files, _READ)
    read = cut_lineage(read.withColumn("brought_in", brought_in))

    compiled = _first_of_id(read.filter((F.col("stage") == RULES) & F.col("reason").isNull()))
    kept = compiled.filter("first")
    named = kept.filter("name is not null").groupBy(F.col("name").alias("base")).agg(F.max_by("rule", F.struct(*_PLACE)).alias("base_rule"))
    correlations = read.filter(F.col("stage") == CORRELATIONS)
    counted = correlations.select(F.explode("counted").alias("name")).distinct()
    done = _dealt(correlations.drop("reason", "rule_id", "name", "rule")).join(named, "base", "left")
    done = cut_lineage(done.mapInArrow(_compile_correlations, "brought_in int, " + _READ))
    taken = kept.select(F.col("rule_id").alias("_taken")).distinct()
    later = _dealt(_first_of_id(done.filter("reason is null"))).join(taken, F.col("rule_id") == F.col("_taken"), "left")
    later = later.withColumn("first", F.col("first") & F.col("_taken").isNull())

    place = [*_PLACE, "path"]
    origin = urls.filter("url is not null").groupBy("file").agg(F.max_by("url", "manifest").alias("url"))
    uncounted = _dealt(kept.filter("name is not null")).join(counted, "name", "left_anti")  # most rules have no name
    rules = uncounted.select(*place, "rule")
    for rows in (kept.filter("name is null"), later.filter("first")):
        rules = rules.unionByName(rows.select(*place, "rule"))
    rules = _dealt(rules.withColumn("file", F.substring_index("path", "#", 1))).join(origin, "file", "left")
    schema = ", ".join([*[f"_{c} {'string' if c == 'file' else 'int'}" for c in _PLACE], RULES_SCHEMA, "rule binary"])
    table = rules.select(*_PLACE, "rule", "url").mapInArrow(_described, schema)

    again = F.concat(F.lit("duplicate rule id "), F.col("rule_id")).alias("reason")
    refused = urls.filter("reason is not null").select(
        F.lit(MANIFESTS).alias("stage"), F.lit(0).alias("brought_in"), F.col("manifest").alias("file"), F.lit(0).alias("at"), F.col("manifest").alias("path"), "reason"
    )
    for rows in (read.filter("reason is not null"), done.filter("reason is not null")):
        refused = refused.unionByName(rows.select(*place, "reason"))
    for rows in (compiled, later):
        refused = refused.unionByName(rows.filter(~F.col("first")).select(*place, again))
    return LoadedRules(cut_lineage(table), cut_lineage(refused))


def import_tally(rule_set: RuleSet | LoadedRules, spark: SparkSession) -> DataFrame:
    """How many rules were selected, and how many refused by reason."""
    kept = rule_set.to_dataframe(spark).select(F.lit("selected").alias("outcome"), F.lit(None).cast("string").alias("reason"))
    refused = rule_set.refused_dataframe(spark).select(F.lit("refused").alias("outcome"), "reason")
    return kept.unionByName(refused).groupBy("outcome", "reason").agg(F.count("*").alias("rules"))


def write_selection(spark: SparkSession, source: str, out: str, release: str) -> LoadedRules:
    """Copy the rules that compile, verbatim, and write a manifest beside them."""
    rule_set = load_rules(spark, source)
    kept = rule_set.to_dataframe(spark).select(F.substring_index("path", "#", 1).alias("path")).distinct()
    selected = _dealt(rule_files(spark, source)).join(kept, "path", "left_semi")
    selected.write.mode("overwrite").parquet(f"{out}/rules")
    manifest = selected.agg(
        F.to_json(
            F.struct(
                F.lit(release).alias("release"),
                F.count("*").alias("selected"),
                F.sort_array(F.collect_list("path")).alias("files"),
            )
        ).alias("value")
    )
    manifest.write.mode("overwrite").text(f"{out}/manifest")
    return rule_set
