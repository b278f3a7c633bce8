"""The interactive prompt."""

from __future__ import annotations

import cmd

from quarry import cli
from quarry.errors import EngineError
from quarry.session import Session


class Prompt(cmd.Cmd):
    intro, prompt = "gen N, compact, query \"...\", set aqp mode fast|balanced|accurate|off, help, exit", "quarry> "

    def __init__(self, session: Session, **options):
        super().__init__(**options)
        self.session = session

    def say(self, text: str) -> None:
        self.stdout.write(f"{text}\n")

    def onecmd(self, line: str) -> bool:
        try:
            return bool(super().onecmd(line))
        except (EngineError, ValueError) as e:
            self.say(f"{type(e).__name__}: {e}")
            return False

    def do_gen(self, text: str) -> None:
        """gen N: append N generated rows."""
        self.say(cli.run(self.session, cli.parser().parse_args(["gen", str(int(text))])))

    def do_compact(self, _: str) -> None:
        """compact: merge what the strategy picks."""
        self.say(f"{self.session.compact()} deltas merged")

    def do_query(self, text: str) -> None:
        """query "SELECT ...": answer a statement."""
        text = text.strip()
        self.say(cli.show(self.session.query(text[1:-1] if text[:1] == text[-1:] == '"' else text)))

    def do_set(self, text: str) -> None:
        """set aqp mode fast|balanced|accurate|off."""
        words = text.lower().split()
        if words[:2] != ["aqp", "mode"] or len(words) != 3:
            raise ValueError("set aqp mode fast|balanced|accurate|off")
        self.session.set_aqp_mode(words[2])
        self.say(f"aqp mode {words[2]}")

    def do_exit(self, _: str) -> bool:
        """exit: leave."""
        return True

    do_EOF = do_exit

    def emptyline(self) -> None:
        pass
