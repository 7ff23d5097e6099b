"""Row locks and advisory locks of the sessions of one engine.

Rows that a change takes away are locked by the file that lists them, however many they are; only the rows of a
SELECT … FOR UPDATE with a limit are held one by one in the driver.
"""

from __future__ import annotations

import threading
import time


class RowLocks:
    def __init__(self):
        self.changed, self.rows, self.files = threading.Condition(), {}, []

    def holder(self, who, table: int, row: int):
        """Another session that holds this row singly."""
        owner = self.rows.get((table, row))
        return owner if owner is not who else None

    def take(self, who, table: int, row: int) -> None:
        with self.changed:
            self.rows[table, row] = who

    def take_file(self, who, table: int, path: str) -> None:
        with self.changed:
            self.files.append((who, table, path))

    def files_of_others(self, who, table: int) -> list[tuple]:
        """(session, path) of the rows that others hold by files."""
        with self.changed:
            return [(o, p) for o, t, p in self.files if t == table and o is not who]

    def rows_of_others(self, who, table: int) -> list[int]:
        with self.changed:
            return [r for (t, r), o in self.rows.items() if t == table and o is not who]

    def wait_for(self, owner, end: float | None) -> bool:
        """Until a session holds nothing any more; False past the end (a monotonic time)."""
        with self.changed:
            while any(o is owner for o, _, _ in self.files) or any(o is owner for o in self.rows.values()):
                left = None if end is None else end - time.monotonic()
                if left is not None and left <= 0:
                    return False
                self.changed.wait(left)
            return True

    def release(self, who) -> None:
        with self.changed:
            self.rows = {k: o for k, o in self.rows.items() if o is not who}
            self.files = [f for f in self.files if f[0] is not who]
            self.changed.notify_all()


class AdvisoryLocks:
    """Re-entrant locks by number; a session waits until the holder has let go as often as it took."""

    def __init__(self):
        self.changed, self.held = threading.Condition(), {}

    def take(self, who, key: int) -> None:
        with self.changed:
            while key in self.held and self.held[key][0] is not who:
                self.changed.wait()
            self.held[key] = (who, self.held.get(key, (who, 0))[1] + 1)

    def free(self, who, key: int) -> bool:
        with self.changed:
            if key not in self.held or self.held[key][0] is not who:
                return False
            n = self.held[key][1] - 1
            if n:
                self.held[key] = (who, n)
            else:
                del self.held[key]
                self.changed.notify_all()
            return True

    def release(self, who) -> None:
        with self.changed:
            self.held = {k: v for k, v in self.held.items() if v[0] is not who}
            self.changed.notify_all()
