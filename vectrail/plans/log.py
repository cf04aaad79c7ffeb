"""Log lines as JSON objects with fields, on standard error."""

from __future__ import annotations

import json
import logging
import sys
import time


class Lines(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        at = time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime(record.created))
        return json.dumps({"time": at, "level": record.levelname.lower(), "logger": record.name, "message": record.getMessage(), **getattr(record, "fields", {})}, default=str)


def logger(name: str = "vectrail", level: str = "INFO") -> logging.LoggerAdapter:
    """A logger whose calls take fields=...: logger().info("inserted", fields={"rows": 3})."""
    found = logging.getLogger(name)
    if not any(isinstance(h.formatter, Lines) for h in found.handlers):
        handler = logging.StreamHandler(sys.stderr)
        handler.setFormatter(Lines())
        found.addHandler(handler)
        found.propagate = False
    found.setLevel(level)
    return _Fields(found, {})


class _Fields(logging.LoggerAdapter):
    def process(self, msg, kwargs):
        return msg, {**{k: v for k, v in kwargs.items() if k != "fields"}, "extra": {"fields": kwargs.get("fields", {})}}
