"""Services for tests: they note what they are asked for in a folder, as workers are other processes."""

import os
import time
from pathlib import Path


class Noting:
    def __init__(self, options):
        self.folder = Path(options["notes"])

    def search(self, code, page, size, since, until):
        with open(self.folder / "asked", "a") as f:
            f.write(f"{code} {page} {since} {until}\n")
        if code == "9":
            raise ConnectionError("down")
        days = (self.folder / "days").read_text().split()
        hits = [{"announcementTitle": f"t{d}", "adjunctUrl": "u", "announcementDate": d} for d in days if (since or "") <= d <= (until or "9")]
        return hits[(page - 1) * size : page * size], len(hits)

    def latest(self):
        return max((self.folder / "days").read_text().split())


def dying(options):
    """Files of 3 chunks; the first time that file 2 is fetched the process dies in the middle of it."""
    flag = Path(options["notes"]) / "died"

    def fetch(url):
        def chunks():
            yield b"%PDF-"
            if url == "2" and not flag.exists():
                flag.touch()
                time.sleep(0.2)
                os._exit(1)
            yield b"x" * 1000
            yield url.encode()

        return 200, chunks()

    return fetch


def failing(options):
    def fetch(url):
        if url == "3":
            os._exit(1)
        return 200, iter([b"%PDF"])

    return fetch
