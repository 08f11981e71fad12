"""Dates for hand-made cases."""

import datetime as dt


def day(text: str) -> dt.date:
    return dt.date.fromisoformat(text)
