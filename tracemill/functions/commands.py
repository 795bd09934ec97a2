"""Which program a shell command runs, and which file it is about: column expressions.

`cmd_name` cuts a command into lexemes with one regular expression and folds them with a small state machine, so that it
stays in the JVM and needs no Python worker."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that are looked at, words before the program at most, longest name.
SCAN, HOPS, LONGEST = 4000, 12, 64
# Programs that run the program behind them, and their options that take the next word.
WRAPPERS = ("sudo", "doas", "env", "time", "nohup", "exec", "command", "builtin", "nice", "stdbuf", "caffeinate")
OPTIONS_WITH_VALUE = {
    "sudo": ("-u", "-g", "-C", "-p", "-r", "-t", "-T", "-D", "-h"),
    "doas": ("-u", "-C"),
    "env": ("-u", "-C", "-S"),
    "time": ("-f", "-o"),
    "nice": ("-n",),
    "stdbuf": ("-i", "-o", "-e"),
    "caffeinate": ("-t", "-w"),
}
# Builtins that only prepare what follows behind the next separator, and other names of builtins.
PREAMBLE = ("cd", "pushd", "popd", "set", "export", "shopt", "umask", "ulimit", "unset", "alias", "local", "declare", "readonly")
ALIASES = {"[": "test", "[[": "test", ".": "source"}
# Programs by what they do with files.
READS = ("cat", "head", "tail", "less", "more")
WRITES = ("cp", "mv", "touch")
FIRST_WORD = (*READS, "rm", "touch", "mkdir", "ls")
FILE_COMMANDS = (*READS, "cp", "mv", "rm", "mkdir", "touch", "ls", "find", "tree", "chmod", "chown", "tar", "zip", "unzip", "sed", "awk", "sort", "wc", "diff", "patch")

_ASSIGNMENT = r"""[A-Za-z_][A-Za-z0-9_]*\+?=(?:"[^"]*"|'[^']*'|`[^`]*`|\$\([^)]*\)|[^\s;&|)]*)"""
_LEXEME = rf"({_ASSIGNMENT}|&&|\|\||\n|[;|&<>(){{}}!]|[^\s;&|<>()]+)"
# States of the fold, and kinds of lexemes.
_SEEK, _WRAPPED, _VALUE, _PREPARED, _FOUND = range(5)
_NEWLINE, _SEPARATOR, _REDIRECT, _BRACKET, _ASSIGN, _WRAPPER, _PREAMBLE, _WORD = range(8)
_TAKERS = {option: tuple(p for p, options in OPTIONS_WITH_VALUE.items() if option in options) for options in OPTIONS_WITH_VALUE.values() for option in options}


def _classified(lexemes: Column) -> Column:
    """Each lexeme with its base name, its kind, whether it is an option, and the wrappers whose option takes the next word.
    Each step of this looks only at what the one before has found, so that nothing is worked out twice."""
    cut = F.transform(lexemes, lambda x: F.struct(x.alias("x"), F.regexp_replace(x, "^['\"`]+|['\"`]+$", "").alias("raw")))
    based = F.transform(cut, lambda e: F.struct(e["x"].alias("x"), e["raw"].alias("raw"), F.lower(F.element_at(F.split(F.regexp_replace(e["raw"], "/+$", ""), "/"), -1)).alias("base")))

    def named(e: Column) -> Column:
        name = F.when(F.lit(False), "")
        for short, long in ALIASES.items():
            name = name.when((e["raw"] == short) | (e["base"] == short), long)
        return F.struct(e["x"].alias("x"), name.otherwise(e["base"]).alias("base"))

    def kind(e: Column) -> Column:
        x = e["x"]
        what = F.when(x == "\n", _NEWLINE).when(x.isin("&&", "||", ";", "|"), _SEPARATOR).when(x.isin("&", "<", ">"), _REDIRECT).when(x.isin("(", ")", "{", "}", "!"), _BRACKET)
        what = what.when(F.contains(x, F.lit("=")) & F.rlike(x, F.lit(f"^{_ASSIGNMENT}")), _ASSIGN).when(e["base"].isin(*WRAPPERS), _WRAPPER).when(e["base"].isin(*PREAMBLE), _PREAMBLE).otherwise(_WORD)
        option = F.startswith(x, F.lit("-")) & (F.length(x) > 1)
        takers = F.when(~option, F.array().cast("array<string>"))
        for name, programs in _TAKERS.items():
            takers = takers.when(x == name, F.array(*map(F.lit, programs)))
        return F.struct(e["base"].alias("base"), what.alias("kind"), option.alias("option"), takers.alias("takers"))

    return F.transform(F.transform(based, named), kind)


def cmd_name(command: Column) -> Column:
    """The lower-case base name of the program that a command runs in effect: behind comments, assignments, wrappers and
    preamble. `(var)` for a variable; empty, never null, if it cannot be told.

    The fold's state is (mode, name, hops). Seeking: assignments and operators are passed over, the first word decides.
    Behind a wrapper its options are passed over, with their values; an operator ends it, and then the wrapper itself is the
    program. Behind a preamble all is passed over up to a separator; without one the preamble is the program."""
    text = F.substring(F.coalesce(command, F.lit("")), 1, SCAN)
    text = F.regexp_replace(text, r"(?m)^[^\S\n]*#.*$", "")
    text = F.regexp_replace(text, r"(?m)\\[^\S\n]*$", "")
    lexemes = F.regexp_extract_all(stripped(text), F.lit(_LEXEME), F.lit(1))
    at = lambda mode, name, hops: F.struct(F.lit(mode).cast("int").alias("mode"), name.alias("name"), hops.alias("hops"))

    def step(s: Column, e: Column) -> Column:
        mode, name, hops, kind = s["mode"], s["name"], s["hops"], e["kind"]
        behind, nothing = (mode == _WRAPPED) | (mode == _VALUE), F.lit("")
        return (
            F.when(mode == _FOUND, s)
            .when(mode == _PREPARED, F.when(kind <= _SEPARATOR, at(_SEEK, nothing, hops)).otherwise(s))
            .when((mode == _VALUE) & (kind > _BRACKET), at(_WRAPPED, name, hops))
            .when(behind & ((kind == _SEPARATOR) | (kind == _REDIRECT)), at(_FOUND, name, hops))
            .when((mode == _WRAPPED) & e["option"], F.when(F.coalesce(F.array_contains(e["takers"], name), F.lit(False)), at(_VALUE, name, hops)).otherwise(s))
            .when(kind <= _BRACKET, F.when(behind & (kind == _NEWLINE), s).otherwise(at(_SEEK, nothing, hops)))
            .when(hops >= HOPS, at(_FOUND, nothing, hops))
            .when(kind == _ASSIGN, at(_SEEK, nothing, hops + 1))
            .when(kind == _WRAPPER, at(_WRAPPED, e["base"], hops + 1))
            .when(kind == _PREAMBLE, at(_PREPARED, e["base"], hops + 1))
            .otherwise(at(_FOUND, F.when(F.startswith(e["base"], F.lit("$")), "(var)").otherwise(F.substring(e["base"], 1, LONGEST)), hops))
        )

    return F.aggregate(_classified(lexemes), at(_SEEK, F.lit(""), F.lit(0)), step, lambda s: s["name"])


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _words(command: Column) -> Column:
    return F.split(stripped(command), r"\s+")


def _program(command: Column) -> Column:
    return F.element_at(F.split(_words(command)[0], "/"), -1)


def category(command: Column) -> Column:
    """BashRead or BashWrite by the first word's base name, else null."""
    return F.when(_program(command).isin(*READS), "BashRead").when(_program(command).isin(*WRITES), "BashWrite")


def is_file_related(command: Column) -> Column:
    return F.coalesce(_program(command).isin(*FILE_COMMANDS), F.lit(False))


def target_file(command: Column) -> Column:
    """The file that a command is about: the first word behind the program that is no option; for copies and moves the
    second one, if there is one."""
    words = _words(command)
    plain = F.filter(F.slice(words, F.lit(2), F.greatest(F.size(words), F.lit(1))), lambda w: ~F.startswith(w, F.lit("-")))
    first = F.get(plain, F.lit(0))
    return F.when(_program(command).isin("cp", "mv"), F.coalesce(F.get(plain, F.lit(1)), first)).when(_program(command).isin(*FIRST_WORD), first)
