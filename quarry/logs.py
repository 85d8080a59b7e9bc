"""Logging from environment variables; off unless a level is set."""

from __future__ import annotations

import json
import logging
import os

LEVEL, JSON, FILE = "QUARRY_LOG_LEVEL", "QUARRY_LOG_JSON", "QUARRY_LOG_FILE"


class JsonFormatter(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        return json.dumps(
            {"time": self.formatTime(record), "level": record.levelname, "logger": record.name, "message": record.getMessage()}
        )


def configure(environ: dict[str, str] | None = None) -> logging.Logger:
    environ = dict(os.environ) if environ is None else environ
    log = logging.getLogger("quarry")
    for handler in list(log.handlers):
        log.removeHandler(handler)
    level = environ.get(LEVEL)
    if not level:
        log.addHandler(logging.NullHandler())
        log.setLevel(logging.CRITICAL + 1)
        return log
    handler = logging.FileHandler(environ[FILE]) if environ.get(FILE) else logging.StreamHandler()
    plain = logging.Formatter("%(asctime)s %(levelname)s %(name)s %(message)s")
    handler.setFormatter(JsonFormatter() if environ.get(JSON) else plain)
    log.addHandler(handler)
    log.setLevel(level.upper())
    return log
