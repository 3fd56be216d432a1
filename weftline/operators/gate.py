"""One limit of calls for all tasks of a run.

The driver keeps a gate for each model of a run: how many calls may be in flight,
which falls by a quarter when the server is busy and grows by one after a run of
successes, and whether too many of the last answers failed. Tasks hold one connection
each and ask for a lease before every call. A lease ends when the task gives it back,
when its connection ends, as that of a lost executor does, or when the task hasn't been
heard of for ``SILENCE`` seconds. Once a gate has stopped nobody gets a lease any more.

What passes is a few bytes a call, so one thread of the driver serves thousands of
tasks; prompts and answers never come here.
"""

from __future__ import annotations

import asyncio
import contextlib
import itertools
import secrets
import socket
import threading
import time
from collections import deque
from dataclasses import dataclass, field
from queue import SimpleQueue

from pyspark.sql import SparkSession

SILENCE = 60.0
PING = 10.0


@dataclass
class Limit:
    """The number of calls that may run at once."""

    most: int = 16
    factor: float = 0.75
    successes: int = 25
    cooldown: float = 2.0

    def __post_init__(self) -> None:
        self.now, self.run, self.busy_until = float(self.most), 0, 0.0

    @property
    def whole(self) -> int:
        return max(1, int(self.now))

    def succeeded(self) -> None:
        self.run += 1
        if self.run >= self.successes:
            self.now, self.run = min(self.most, self.now + 1), 0

    def refused(self, at: float) -> None:
        self.now, self.run = max(1.0, self.now * self.factor), 0
        self.busy_until = at + self.cooldown


class FailureWindow:
    """Tells when too many of the last answers failed."""

    def __init__(self, rate: float, window: int) -> None:
        self.rate, self.last = rate, deque(maxlen=window)

    def add(self, failed: bool) -> bool:
        self.last.append(failed)
        return len(self.last) == self.last.maxlen and sum(self.last) / len(self.last) >= self.rate


@dataclass(eq=False)
class Holder:
    """A task's connection."""

    writer: asyncio.StreamWriter
    leases: int = 0
    heard: float = field(default_factory=time.monotonic)

    def say(self, word: bytes) -> None:
        with contextlib.suppress(Exception):
            self.writer.write(word)


class Gate:
    """State of one model's calls; used by the server's thread alone."""

    def __init__(self, limit: Limit, window: FailureWindow | None) -> None:
        self.limit, self.window, self.flying, self.stopped = limit, window, 0, False
        self.waiting: deque[Holder] = deque()

    def want(self, holder: Holder) -> None:
        self.waiting.append(holder)
        self.admit()

    def admit(self) -> None:
        now = time.monotonic()
        while self.waiting and (self.stopped or self.flying < self.limit.whole and now >= self.limit.busy_until):
            holder = self.waiting.popleft()
            if self.stopped:
                holder.say(b"s\n")
            else:
                self.flying += 1
                holder.leases += 1
                holder.say(b"g\n")

    def give_back(self, holder: Holder, how: str) -> None:
        if holder.leases:
            holder.leases -= 1
            self.flying -= 1
        if how == "ok":
            self.limit.succeeded()
        elif how == "busy":
            self.limit.refused(time.monotonic())
        self.admit()

    def told(self, failed: bool) -> None:
        if self.window is not None and self.window.add(failed):
            self.stopped = True
            self.admit()

    def gone(self, holder: Holder) -> None:
        self.flying -= holder.leases
        holder.leases = 0
        self.waiting = deque(h for h in self.waiting if h is not holder)
        self.admit()


@dataclass(frozen=True)
class Address:
    """Where tasks find a gate."""

    host: str
    port: int
    token: str
    gate: int


class Server:
    """All gates of this driver, behind one port and one thread."""

    def __init__(self, host: str) -> None:
        self.host, self.token, self.gates, self.numbers = host, secrets.token_hex(16), {}, itertools.count()
        self.loop, self.ready = asyncio.new_event_loop(), threading.Event()
        threading.Thread(target=self._run, daemon=True, name="weftline-gate").start()
        self.ready.wait()

    def _run(self) -> None:
        asyncio.set_event_loop(self.loop)
        server = self.loop.run_until_complete(asyncio.start_server(self._serve, self.host, 0))
        self.port = server.sockets[0].getsockname()[1]
        self.holders: dict[Holder, Gate] = {}
        self.loop.create_task(self._watch())
        self.ready.set()
        self.loop.run_forever()

    async def _watch(self) -> None:
        """Lets calls in again when a pause is over, and ends connections that have gone silent."""
        while True:
            await asyncio.sleep(0.1)
            for gate in list(self.gates.values()):
                gate.admit()
            for holder in [h for h in self.holders if time.monotonic() - h.heard > SILENCE]:
                holder.writer.close()

    async def _serve(self, reader: asyncio.StreamReader, writer: asyncio.StreamWriter) -> None:
        holder, gate = Holder(writer), None
        try:
            token, _, number = (await reader.readline()).decode().strip().partition(" ")
            gate = self.gates.get(int(number)) if secrets.compare_digest(token, self.token) else None
            if gate is None:
                return
            self.holders[holder] = gate
            while line := (await reader.readline()).decode().strip():
                holder.heard = time.monotonic()
                word, _, rest = line.partition(" ")
                if word == "w":
                    gate.want(holder)
                elif word == "d":
                    gate.give_back(holder, rest)
                elif word == "t":
                    gate.told(rest == "failed")
        except (ConnectionError, ValueError, OSError):
            pass
        finally:
            if gate is not None:
                self.holders.pop(holder, None)
                gate.gone(holder)
            writer.close()

    def open(self, limit: Limit, window: FailureWindow | None) -> Address:
        number = next(self.numbers)
        self.gates[number] = Gate(limit, window)
        return Address(self.host, self.port, self.token, number)

    def close(self, address: Address) -> None:
        self.gates.pop(address.gate, None)


_SERVER: list[Server] = []


def server(spark: SparkSession) -> Server:
    if not _SERVER:
        _SERVER.append(Server(spark.conf.get("spark.driver.host", "127.0.0.1")))
    return _SERVER[0]


class Leases:
    """A task's side of a gate. ``enter`` waits for a lease and is false once the gate has stopped."""

    def __init__(self, address: Address) -> None:
        self.socket = socket.create_connection((address.host, address.port), timeout=60)
        self.socket.settimeout(None)
        self.lock, self.answers, self.over = threading.Lock(), SimpleQueue(), threading.Event()
        self._say(f"{address.token} {address.gate}")
        threading.Thread(target=self._listen, daemon=True).start()
        threading.Thread(target=self._ping, daemon=True).start()

    def _say(self, words: str) -> None:
        with self.lock:
            self.socket.sendall(f"{words}\n".encode())

    def _listen(self) -> None:
        with contextlib.suppress(OSError), self.socket.makefile("rb") as held:
            for line in held:
                self.answers.put(line.strip() == b"g")
        self.over.set()
        for _ in range(1024):  # nobody waits for a driver that is gone
            self.answers.put(None)

    def _ping(self) -> None:
        while not self.over.wait(PING):
            with contextlib.suppress(OSError):
                self._say("p")

    def enter(self) -> bool:
        self._say("w")
        answer = self.answers.get()
        if answer is None:
            raise ConnectionError("the driver's gate is gone")
        return answer

    def leave(self, how: str) -> None:
        """``ok``, ``busy`` where the server refused the call, or ``failed``."""
        self._say(f"d {how}")

    def told(self, failed: bool) -> None:
        """What became of a row."""
        self._say(f"t {'failed' if failed else 'ok'}")

    def close(self) -> None:
        self.over.set()
        with contextlib.suppress(OSError):
            self.socket.shutdown(socket.SHUT_RDWR)
            self.socket.close()
