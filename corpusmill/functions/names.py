"""Names, paths and small text formats: checks on the driver and column expressions."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What no portable path may hold, and names that some systems keep for devices.
FORBIDDEN = '\\:*?"<>|'
DEVICES = {"CON", "PRN", "AUX", "NUL", *(f"{kind}{n}" for kind in ("COM", "LPT") for n in range(1, 10))}


def safe_relative(path: str) -> str:
    """The path, if it is relative and means the same file on every system; else an error."""

    def bad(part: str) -> bool:
        return part in ("", ".", "..") or part[-1] in ". " or part.split(".")[0].upper() in DEVICES

    if any(c in FORBIDDEN or ord(c) < 32 or 127 <= ord(c) < 160 for c in path) or any(map(bad, path.split("/"))):
        raise ValueError(f"unsafe relative path: {path!r}")
    return path


def glob_pattern(glob: str) -> re.Pattern:
    """A glob whose * and ? stay inside a folder and whose ** is any number of folders; [...] and {a,b} as usual."""
    out, depth, i = "", 0, 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out, i = out + "(?:[^/]+/)*", i + 3
            continue
        if glob.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        if c == "[" and (end := glob.find("]", i + 2)) > 0:
            inside = glob[i + 1 : end].replace("\\", r"\\")
            out, i = out + "(?!/)[" + ("^" + inside[1:] if inside[0] == "!" else inside) + "]", end + 1
            continue
        if c == "{" and "}" in glob[i:]:
            depth, c = depth + 1, "(?:"
        elif c == "}" and depth:
            depth, c = depth - 1, ")"
        elif c == "," and depth:
            c = "|"
        else:
            c = {"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c))
        out, i = out + c, i + 1
    return re.compile(out + r"\Z", re.DOTALL)


def safe_glob(glob: str) -> re.Pattern:
    """glob_pattern() of a relative glob without ways out of its folder."""
    if not glob or "\\" in glob or ":" in glob or any(p in ("", ".", "..") for p in glob.split("/")):
        raise ValueError(f"unsafe file glob: {glob!r}")
    return glob_pattern(glob)


def matching(paths: Iterable[str], globs: Sequence[str]) -> list[str]:
    """The paths that some glob matches, each once, sorted; a glob without a match is an error."""
    found: set[str] = set()
    paths = list(paths)
    for g in globs:
        hits = [p for p in paths if safe_glob(g).match(p)]
        if not hits:
            raise ValueError(f"no file matches {g}")
        found.update(hits)
    return sorted(found)


def path_key(path: Column) -> Column:
    """For sorting: paths part by part, so that a folder's files stay together ("a/b" before "a.b")."""
    return F.split(path, "/")


def run_name(name: str) -> str:
    """A run's name in lower case; letters, digits, - and _ only."""
    if not re.fullmatch(r"[A-Za-z0-9_-]+", name):
        raise ValueError(f"not a run name: {name!r}")
    return name.lower()


def run_number(name: Column, run: str) -> Column:
    """The number in "<run>-<number>", in any case and with leading zeros, as decimal(20,0); null for other names. Over 64 bits it is an error."""
    digits = F.regexp_extract(name, rf"\A(?i:{re.escape(run_name(run))})-([0-9]+)\z", 1)
    plain = F.ltrim(digits, F.lit("0"))
    number = F.when(F.length(plain) <= 20, F.when(plain == "", "0").otherwise(plain).cast("decimal(20,0)"))
    too_large = (digits != "") & (number.isNull() | (number > F.lit(str(2**64 - 1)).cast("decimal(20,0)")))
    return F.when(digits == "", F.lit(None)).when(too_large, F.raise_error(F.concat(F.lit("a number over 64 bits in "), name)).cast("decimal(20,0)")).otherwise(number)


def next_number(names: Iterable[str], run: str) -> int:
    """One more than the largest number of a run's entries; 1 if there are none."""
    found = [int(m[1]) for n in names if (m := re.fullmatch(rf"{re.escape(run_name(run))}-([0-9]+)", n, re.IGNORECASE | re.ASCII))]
    if found and max(found) >= 2**64 - 1:
        raise ValueError(f"numbers of {run} are used up")
    return max(found, default=0) + 1


def record_number(doc_id: Column) -> Column:
    """The line number in "<path>.jsonl/@record-<number>", without leading zeros; null for other ids."""
    digits = F.regexp_extract(doc_id, r"\A(?:[^/]+/)*[^/]+\.jsonl/@record-([1-9][0-9]{0,17})\z", 1)
    return F.when(digits != "", digits.cast("long"))


def folder_weight(text: str) -> tuple[str, int]:
    """FOLDER=WEIGHT, cut at the last sign."""
    folder, sign, weight = text.rpartition("=")
    if not sign or not folder or not re.fullmatch(r"\+?[0-9]+", weight) or not 0 < int(weight) < 2**64:
        raise ValueError(f"expected FOLDER=WEIGHT with a positive weight: {text!r}")
    return folder, int(weight)


def split_policy(text: str) -> tuple[str, float | int | None]:
    """none, count:N or ratio:R as (kind, value)."""
    kind, _, value = text.partition(":")
    if text == "none":
        return "none", None
    if kind == "count" and re.fullmatch(r"[0-9]+", value):
        return kind, int(value)
    if kind == "ratio" and re.fullmatch(r"[0-9]*\.?[0-9]+(e-?[0-9]+)?", value):
        return kind, float(value)
    raise ValueError(f"unknown split policy: {text!r}")


def split_policy_text(kind: str, value: float | int | None = None) -> str:
    return kind if value is None else f"{kind}:{value!r}"


def selected_files(root: str, selections: Sequence[str], suffix: str = ".txt") -> list[str]:
    """Files with the suffix under the selected folders of root, each once however often its folder is selected, part by part in order.

    Folders are relative names inside root; links are refused.
    """
    base = Path(root).resolve()
    files: set[Path] = set()
    for name in selections or ["."]:
        folder = base if name == "." else base / safe_relative(name)
        for part in (folder, *folder.parents):
            if part == base:
                break
            if part.is_symlink():
                raise ValueError(f"{name} leads through a link")
        if not folder.is_dir():
            raise ValueError(f"{name} isn't a folder of {root}")
        for path in folder.rglob("*"):
            if path.is_symlink():
                raise ValueError(f"{path} is a link")
            if path.is_file() and path.suffix == suffix:
                files.add(path)
    return [str(p) for p in sorted(files, key=lambda p: p.parts)]


def resolved_format(found: Sequence[tuple[str, str] | None], requested: str = "auto", *, training: bool = False, split: str = "none") -> str:
    """The format of a selection: of published partitions their stage's (base: jsonl, chat: chat), of other folders text, unless one is asked for.

    found: per selected folder (stage, partition) of a release, or None.
    """
    published = {f for f in found if f}
    if not published:
        return "text" if requested == "auto" else requested
    if len(published) > 1 or None in found:
        raise ValueError("select one stage and partition of a release, and no other folder beside it")
    stage, partition = published.pop()
    if training and partition != "train":
        raise ValueError(f"{partition} is held out; training takes train")
    if split_policy(split)[1]:
        raise ValueError("a release is split already")
    own = {"base": "jsonl", "chat": "chat"}[stage]
    if requested not in ("auto", own):
        raise ValueError(f"this partition is {own}, not {requested}")
    return own
