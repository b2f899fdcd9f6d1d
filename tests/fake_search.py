"""An announcement search for tests: three hits for code 1, one for others."""


def search(code, page, size):
    hits = [{"announcementTitle": f"t{i}", "adjunctUrl": "u", "announcementDate": "2020-01-01"} for i in range(3 if code == "1" else 1)]
    return hits[(page - 1) * size : page * size], len(hits)
