"""A small prompt over a store: `python -m quern.cli theory.json`."""

from __future__ import annotations

import re
import shlex
import sys
from collections.abc import Iterable, Iterator
from pathlib import Path

from pyspark.sql import SparkSession

from quern.operators.store import Handle, Rejected, Store, StoreError, Transaction
from quern.plans.theory import Theory, from_json

HELP = """.help  .exit  .quit
.load THEORY.json     an empty store of a theory
.open DIR / .save DIR a store's commit log
.tables  .schema  .rules  .dump [TABLE]
add TABLE values A, B, ...     numbers, 'text', or a name given with `as`
add TABLE values ... as NAME   name the row for later rows of the transaction
begin transact; ... commit;    several rows as one commit; rollback;
COPY TABLE FROM 'FILE' [DELIMITER 'x']"""
_ADD = re.compile(r"add\s+(\S+)(?:\s+values\s+(.*?))?(?:\s+as\s+(\w+))?$", re.I | re.S)
_COPY = re.compile(r"copy\s+(\S+)\s+from\s+'([^']*)'(?:.*?delimiter\s+E?'([^']*)')?.*$", re.I | re.S)


class Prompt:
    def __init__(self, spark: SparkSession):
        self.spark, self.theory, self.store = spark, Theory(()), None
        self.transaction: Transaction | None = None
        self.names: dict[str, Handle] = {}

    def _store(self) -> Store:
        if self.store is None:
            raise StoreError("no theory is loaded")
        return self.store

    def _values(self, text: str) -> list[object]:
        lexer = shlex.shlex(text, posix=False)
        lexer.wordchars += "-"
        out: list[object] = []
        for word in (w for w in lexer if w != ","):
            if word[0] in "'\"":
                out.append(word[1:-1])
            elif re.fullmatch(r"-?\d+", word):
                out.append(int(word))
            elif word in self.names:
                out.append(self.names[word])
            else:
                raise StoreError(f"can't read the value {word}")
        return out

    def run(self, line: str) -> str:
        """Do what one line or statement says; the text to print."""
        line = line.strip().rstrip(";").strip()
        word, _, rest = line.partition(" ")
        rest = rest.strip()
        match word.lower():
            case "" | ".exit" | ".quit":
                return ""
            case ".help":
                return HELP
            case ".load":
                self.theory = from_json(Path(rest).read_text())
                self.store = Store(self.spark, self.theory)
                return f"{len(self.theory.entities)} tables"
            case ".open":
                self.store = Store.load(self.spark, self.theory, rest)
                return f"{len(self.store.commits)} commits"
            case ".save":
                self._store().save(rest)
                return f"saved {len(self._store().commits)} commits"
            case ".tables":
                return "\n".join(self._store().tables)
            case ".schema":
                keys = {None: "", (): " at most one row"}
                return "\n".join(f"{e.name}({', '.join(f'{c.name} {c.target or c.type}' for c in e.columns)}){keys.get(e.key, f' key {e.key}')}" for e in self.theory.entities)
            case ".rules":
                return "\n".join(map(str, self.theory.laws))
            case ".dump":
                return "\n".join(f"{t}\n{df._show_string(20, False)}" for t, df in self._store().tables.items() if rest in ("", t))
            case "begin":
                self.transaction, self.names = self._store().transaction(), {}
                return "begun"
            case "rollback":
                self.transaction = None
                return "rolled back"
            case "commit":
                if self.transaction is None:
                    raise StoreError("no transaction")
                t, self.transaction = self.transaction, None
                return f"committed {t.commit()[:12]}"
            case "add":
                m = _ADD.match(line)
                if not m:
                    raise StoreError(HELP)
                alone = self.transaction is None
                t = self.transaction or self._store().transaction()
                handle = t.add(m[1], *self._values(m[2] or ""))
                if m[3]:
                    self.names[m[3]] = handle
                return f"committed {t.commit()[:12]}" if alone else "added"
            case "copy":
                m = _COPY.match(line)
                if not m:
                    raise StoreError(HELP)
                return f"committed {self._store().copy_into(m[1], m[2], (m[3] or ',').replace(chr(92) + 't', chr(9)))[:12]}"
        raise StoreError(f"unknown command {word}; .help lists them")

    def session(self, lines: Iterable[str]) -> Iterator[str]:
        """Answers to all lines; an error is an answer, too."""
        for line in lines:
            if line.strip() in (".exit", ".quit"):
                return
            for statement in [line] if line.lstrip().startswith(".") else line.split(";"):
                try:
                    if said := self.run(statement):
                        yield said
                except (StoreError, Rejected, ValueError, OSError) as e:
                    yield f"error: {e}"


def main() -> None:
    spark = SparkSession.builder.appName("quern").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    prompt = Prompt(spark)
    for path in sys.argv[1:2]:
        print(prompt.run(f".load {path}"))
    for said in prompt.session(sys.stdin):
        print(said, flush=True)


if __name__ == "__main__":
    main()
