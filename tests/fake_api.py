"""What a paged source fetches in the tests."""

RECORDS = [{"id": i, "title": f"m{i}"} for i in range(250)]


def fetch(offset, limit):
    return RECORDS[offset : offset + limit]


def wrong(offset, limit):
    return {"not": "a list"}


def one(identifier):
    return {"id": int(identifier)}
