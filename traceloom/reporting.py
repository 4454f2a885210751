"""What commands tell the person who runs them: messages to standard error, with a level that can be silenced."""
from __future__ import annotations

import logging
import sys

_log = logging.getLogger("traceloom")


def setup(verbose: bool = False) -> None:
    """Messages go to standard error as plain lines; warnings and errors are marked."""
    handler = logging.StreamHandler(sys.stderr)
    handler.setFormatter(logging.Formatter("%(levelname).1s %(message)s"))
    _log.handlers[:] = [handler]
    _log.setLevel(logging.DEBUG if verbose else logging.INFO)
    _log.propagate = False


def say(message: str, *values: object) -> None:
    _log.info(message, *values)


def detail(message: str, *values: object) -> None:
    _log.debug(message, *values)


def warn(message: str, *values: object) -> None:
    _log.warning(message, *values)


def stop(message: str, code: int = 2) -> SystemExit:
    """The error to raise where a command cannot go on."""
    _log.error(message)
    return SystemExit(code)
