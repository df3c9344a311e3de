"""A subscriber for tests: numbered messages, one of them empty."""

BODIES = ["a,1", None, "b,2", "HEARTBEAT", "c,3"]


def read(start, end):
    return BODIES[start:end]


def count():
    return len(BODIES)
