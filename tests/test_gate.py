"""One limit and one stop for all tasks of a run."""

import json
import socket
import socketserver
import threading
import time

import pytest
from pyspark.sql import functions as F

from weftline.operators.gate import FailureWindow, Gate, Leases, Limit, Server
from weftline.operators.generate import CallRules, ModelError
from weftline.plans.config import Builder
from weftline.plans.engine import Engine, RunConfig
from weftline.plans.planner import Resources


class Watch:
    """Counts how many clients, of whatever process, are within a call, and how many calls there were."""

    def __init__(self):
        watch = self
        self.now = self.most = self.calls = 0
        self.lock = threading.Lock()

        class Handler(socketserver.BaseRequestHandler):
            def handle(self):
                with watch.lock:
                    watch.now += 1
                    watch.calls += 1
                    watch.most = max(watch.most, watch.now)
                self.request.sendall(b"x")
                self.request.recv(1)
                with watch.lock:
                    watch.now -= 1
                self.request.sendall(b"y")

        self.server = socketserver.ThreadingTCPServer(("127.0.0.1", 0), Handler)
        self.server.daemon_threads = True
        threading.Thread(target=self.server.serve_forever, daemon=True).start()

    def client(self, fails=False, busy=False):
        port = self.server.server_address[1]

        def ask(kind, messages, parameters):
            with socket.create_connection(("127.0.0.1", port)) as s:
                s.recv(1)
                time.sleep(0.02)
                s.sendall(b"z")
                s.recv(1)
            if fails:
                raise ModelError("no")
            return {"content": messages[-1]["content"]}

        return ask


@pytest.fixture
def watch():
    w = Watch()
    yield w
    w.server.shutdown()


def asking(spark, n, parts=8):
    seeds = spark.range(n).withColumnRenamed("id", "n")
    return Builder(1).add_model("m", "any").with_seed(seeds).add_column(name="said", kind="llm-text", prompt="{{ n }}", model_alias="m")


@pytest.mark.parametrize("limit", [3, 16])
def test_all_tasks_share_one_limit(spark, tmp_path, watch, limit):
    engine = Engine(spark, Resources(models={"m": watch.client()}), RunConfig(calls=CallRules(most_calls=limit)))
    out = engine.create(asking(spark, 240), 240, f"{tmp_path}/set")
    assert out.count_records() == 240 and watch.calls == 240
    assert 1 < watch.most <= limit


def test_a_failing_model_is_asked_a_bounded_number_of_times(spark, tmp_path, watch):
    """Whatever the number of tasks; what was left is made when the run is resumed."""
    rc = RunConfig(buffer_size=50, calls=CallRules(most_calls=4), resume="always")
    b = asking(spark, 800)
    out = Engine(spark, Resources(models={"m": watch.client(fails=True)}), rc)
    with pytest.raises(Exception, match="too few"):
        out.create(b, 800, f"{tmp_path}/set")
    assert 10 <= watch.calls <= 10 + 4 + 4
    meta = json.loads((tmp_path / "set" / "metadata.json").read_text())
    assert meta["stopped_early"] and meta["dropped"]["said:stopped"] > 700 and len(meta["incomplete"]) > 8
    again = Engine(spark, Resources(models={"m": watch.client()}), rc).create(b, 800, f"{tmp_path}/set")
    meta = json.loads((tmp_path / "set" / "metadata.json").read_text())
    assert not meta["incomplete"] and "said:stopped" not in meta["dropped"]
    assert again.count_records() >= 800 - watch.calls and again.load_dataset().where(F.col("n").isNull()).count() == 0


# ---- the gate itself


@pytest.fixture
def driver():
    return Server("127.0.0.1")


def test_leases_of_a_lost_task_come_back(driver):
    address = driver.open(Limit(2), None)
    lost, other = Leases(address), Leases(address)
    assert lost.enter() and lost.enter()
    got = []
    waiting = threading.Thread(target=lambda: got.append(other.enter()))
    waiting.start()
    time.sleep(0.3)
    assert not got
    lost.socket.shutdown(socket.SHUT_RDWR)
    waiting.join(5)
    assert got == [True]
    other.close()


def test_a_busy_server_lowers_the_limit_for_all(driver):
    address = driver.open(Limit(8, cooldown=0.5), None)
    a, b = Leases(address), Leases(address)
    assert a.enter()
    began = time.monotonic()
    a.leave("busy")
    assert b.enter() and time.monotonic() - began >= 0.45
    assert driver.gates[address.gate].limit.whole == 6
    for _ in range(25):
        assert a.enter()
        a.leave("ok")
    b.leave("ok")
    deadline = time.monotonic() + 5
    while driver.gates[address.gate].limit.whole < 7 and time.monotonic() < deadline:
        time.sleep(0.01)
    assert driver.gates[address.gate].limit.whole == 7
    a.close()
    b.close()


def test_a_stopped_gate_lets_nobody_in(driver):
    address = driver.open(Limit(2), FailureWindow(0.5, 4))
    a, b = Leases(address), Leases(address)
    for failed in (False, True, False, True):
        a.told(failed)
    assert not a.enter() and not b.enter()
    a.close()
    b.close()


def test_strangers_are_turned_away(driver):
    address = driver.open(Limit(2), None)
    for words in (b"wrong 0\nw\n", b"\n", f"{driver.token} 99\nw\n".encode(), b"x" * 10):
        with socket.create_connection((address.host, address.port)) as s:
            s.sendall(words)
            s.shutdown(socket.SHUT_WR)
            assert s.recv(10) == b""
    assert driver.gates[address.gate].flying == 0


def test_order_of_waiting_is_kept():
    said = []
    gate = Gate(Limit(1), None)
    holders = [type("H", (), {"leases": 0, "say": lambda self, w, i=i: said.append(i)})() for i in range(3)]
    for h in holders:
        gate.want(h)
    gate.give_back(holders[0], "ok")
    gate.gone(holders[1])
    assert said == [0, 1, 2]
