"""Which tool calls only read: a list of tools, and of commands whose segments are all harmless."""
from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Tools, commands, sub-commands and options that are known to read only, or to write.
TOOLS = ("Read", "Grep", "Glob", "LS", "ToolSearch", "ListAgents", "TaskList", "TaskGet")
ANY_ARGUMENT = "cd pwd cat echo printf grep egrep fgrep ls head tail wc jq stat diff nl cut tr basename dirname realpath which true".split()
FORBIDDEN = {
    "rg": r"--pre",
    "tree": r"-[a-zA-Z]*[oR]|--o",
    "file": r"-[a-zA-Z]*C|--c",
    "sort": r"-[a-zA-Z]*o|--o|--c",
    "find": r"-(exec|execdir|ok|okdir|delete|fprint|fprint0|fprintf|fls)$",
}
GIT_READS = "status log diff show rev-parse ls-files blame describe shortlog rev-list merge-base cat-file grep".split()
GIT_BRANCH = "-a -r -v -vv --all --remotes --list --show-current --verbose --no-color --color".split()
HARMLESS_REDIRECT = r"((\d|&)?>>?\s*/dev/null|\d?>&\d)(?=[\s;&|]|$)"
REPORTS_ERROR = r'"stderr":\s*"[^"]|"interrupted":\s*true|"is_error":\s*true'

PIECES = re.compile(r"""(?P<space>[ \t\r\f\v]+)|(?P<end>[&|;\n])|(?P<bad>`|>|\$\(|<\(|\$')|\\(?P<escaped>.?)|'(?P<single>[^']*)'|"(?P<double>(?:[^"\\]|\\.)*)"|(?P<open>['"])|(?P<plain>.)""", re.S)


def segments(command: str) -> list[list[str]] | None:
    """Words of the commands that a line joins, quotes taken off; none if it writes, substitutes or leaves a quote open."""
    out: list[list[str]] = [[]]
    word = ""
    for piece in PIECES.finditer(re.sub(HARMLESS_REDIRECT, " ", command)):
        kind = piece.lastgroup
        if kind in ("bad", "open"):
            return None
        if kind in ("space", "end"):
            if word:
                out[-1].append(word)
            word = ""
            if kind == "end":
                out.append([])
        elif kind == "double":
            if re.search(r"`|\$\(", re.sub(r"\\.", "", piece[kind], flags=re.S)):
                return None
            word += re.sub(r"\\(.)", r"\1", piece[kind], flags=re.S)
        else:
            word += piece[kind]
    if word:
        out[-1].append(word)
    return [words for words in out if words]


def reads_git(args: list[str]) -> bool:
    while args[:1] == ["--no-pager"] or args[:1] == ["-C"]:
        args = args[2 if args[0] == "-C" else 1:]
    if not args:
        return False
    command, rest = args[0], args[1:]
    if any(a.startswith("--output") for a in rest) or command == "grep" and any(re.match(r"-[a-zA-Z]*O|--op", a) for a in rest):
        return False
    return command in GIT_READS or command == "branch" and all(a in GIT_BRANCH for a in rest)


def reads_only(command: str | None) -> bool:
    """Null, blank and unreadable commands count as writing."""
    found = segments(command or "")
    if not found:
        return False
    for name, *args in found:
        name = re.sub(r"^/(usr/)?bin/", "", name)
        if name == "git":
            good = reads_git(args)
        elif name == "uniq":
            good = "--" not in args and sum(a == "-" or not a.startswith("-") for a in args) <= 1
        elif name in FORBIDDEN:
            good = not any(re.match(FORBIDDEN[name], a) for a in args)
        else:
            good = name in ANY_ARGUMENT
        if not good:
            return False
    return True


@F.pandas_udf(T.BooleanType())
def reads_only_column(commands: pd.Series) -> pd.Series:
    return commands.map(reads_only).astype(bool)


def read_only_call(hook: Column, tool: Column, command: Column, output: Column) -> Column:
    """A call that has ended without an error, of a tool that only reads or of a shell command that does; null counts as no."""
    fine = (hook == "post_tool_use") & ~F.coalesce(output.rlike(REPORTS_ERROR), F.lit(False))
    known = tool.isin(*TOOLS)
    shell = (tool == "Bash") & command.isNotNull()
    return F.coalesce(fine & (known | (shell & reads_only_column(F.when(shell, command)))), F.lit(False))
