"""A model in a child process of the Python worker: one that hangs or dies fails the recording at hand, and nothing else.

The child serves one request after another over two pipes, each a length and a pickled value. It is forked from a second process of the
worker, which has imported what a child needs and holds no model: a new child in place of a dead one takes milliseconds and the loading of
its model. Both end when the worker does. What a model prints goes to the worker's error output.
"""

from __future__ import annotations

import os
import pickle
import selectors
import signal
import socket
import struct
import subprocess
import sys
import time
from typing import Any, BinaryIO

from pyspark import cloudpickle


def _send(to: BinaryIO, value: bytes) -> None:
    to.write(struct.pack(">Q", len(value)) + value)
    to.flush()


class Nursery:
    """The process that children are forked from. It takes the ends of a child's pipes and answers with its pid; it takes a pid, and whether
    to wait for it, and answers with its exit code, or RUNNING."""

    RUNNING = 1 << 20

    def __init__(self) -> None:
        path = os.pathsep.join(dict.fromkeys(p for p in (*sys.path, *os.environ.get("PYTHONPATH", "").split(os.pathsep)) if p))
        self.socket, other = socket.socketpair(socket.AF_UNIX, socket.SOCK_SEQPACKET)
        with other:
            self.process = subprocess.Popen([sys.executable, "-m", "cadence.operators.supervised", str(other.fileno())], stdin=subprocess.DEVNULL, stdout=2, pass_fds=[other.fileno()], env=os.environ | {"PYTHONPATH": path})
        self.owner = os.getpid()

    def _ask(self, message: bytes, fds: list[int]) -> int:
        socket.send_fds(self.socket, [message], fds)
        if not (answer := self.socket.recv(8)):
            raise ChildProcessError("the process that starts models has ended")
        return struct.unpack(">q", answer)[0]

    def fork(self, requests: int, answers: int) -> int:
        return self._ask(b"fork", [requests, answers])

    def code(self, pid: int, wait: bool) -> int | None:
        given = self._ask(struct.pack(">q?", pid, wait), [])
        return None if given == self.RUNNING else given


_nursery: Nursery | None = None


def _of_worker() -> Nursery:
    global _nursery
    if _nursery is None or _nursery.owner != os.getpid() or _nursery.process.poll() is not None:
        _nursery = Nursery()
    return _nursery


class Child:
    """serve: a picklable function () -> (request -> answer), which runs in the child; it may take load_limit seconds."""

    def __init__(self, serve: Any, load_limit: float):
        (theirs, to), (back, answers) = os.pipe(), os.pipe()
        self.nursery, self._code = _of_worker(), None
        try:
            self.pid = self.nursery.fork(theirs, answers)
        finally:
            os.close(theirs)
            os.close(answers)
            self.requests, self.answers = os.fdopen(to, "wb", buffering=0), os.fdopen(back, "rb", buffering=0)
        self._ask(cloudpickle.dumps(serve), load_limit)

    def ask(self, request: Any, limit: float) -> Any:
        return self._ask(cloudpickle.dumps(request), limit)

    def _ask(self, request: bytes, limit: float) -> Any:
        """The child's answer, or its exception; TimeoutError or ChildProcessError, after which the child is gone."""
        end = time.monotonic() + limit
        try:
            _send(self.requests, request)
            size = struct.unpack(">Q", self._read(8, end, limit))[0]
            good, value = pickle.loads(self._read(size, end, limit))
        except (EOFError, BrokenPipeError):
            code = self._ended(True)
            raise ChildProcessError(f"the model's process ended with code {code}") from None
        except TimeoutError:
            self.stop()
            raise
        if not good:
            raise value
        return value

    def _read(self, size: int, end: float, limit: float) -> bytes:
        out = b""
        with selectors.DefaultSelector() as ready:
            ready.register(self.answers, selectors.EVENT_READ)
            while len(out) < size:
                if not ready.select(max(0.0, end - time.monotonic())):
                    raise TimeoutError(f"no answer within {limit:g} s")
                part = os.read(self.answers.fileno(), min(size - len(out), 1 << 20))
                if not part:
                    raise EOFError
                out += part
        return out

    def _ended(self, wait: bool) -> int | None:
        """The child's exit code, or None while it runs."""
        if self._code is None:
            self._code = self.nursery.code(self.pid, wait)
        return self._code

    def stop(self) -> None:
        if self._ended(False) is None:
            os.kill(self.pid, signal.SIGKILL)
            self._ended(True)
        for pipe in (self.requests, self.answers):
            pipe.close()

    @property
    def alive(self) -> bool:
        return self._ended(False) is None


def _serve(requests: BinaryIO, answers: BinaryIO) -> None:
    serve = None
    while head := requests.read(8):
        body = requests.read(struct.unpack(">Q", head)[0])
        try:
            if serve is None:
                serve, given = pickle.loads(body)(), None
            else:
                given = serve(pickle.loads(body))
            answer = cloudpickle.dumps((True, given))
        except Exception as e:  # noqa: BLE001  the worker raises it
            try:
                answer = cloudpickle.dumps((False, e))
                pickle.loads(answer)
            except Exception:  # noqa: BLE001  an exception that can't be sent
                answer = cloudpickle.dumps((False, RuntimeError(f"{type(e).__name__}: {e}")))
        _send(answers, answer)


def _main(own: socket.socket) -> None:
    """Forks a child for each pair of pipes, until the worker's end is closed."""
    import cadence.operators.inference  # noqa: F401  what the children need

    while True:
        message, fds, _, _ = socket.recv_fds(own, 64, 2)
        if not message:
            return
        if fds:
            answer = os.fork()
            if not answer:
                own.close()
                code = 1
                try:
                    with os.fdopen(fds[0], "rb") as requests, os.fdopen(fds[1], "wb") as answers:
                        _serve(requests, answers)
                    code = 0
                except SystemExit as e:
                    code = e.code if isinstance(e.code, int) else int(e.code is not None)
                finally:
                    sys.stdout.flush()
                    sys.stderr.flush()
                    os._exit(code)
            for fd in fds:
                os.close(fd)
        else:
            pid, wait = struct.unpack(">q?", message)
            done, status = os.waitpid(pid, 0 if wait else os.WNOHANG)
            answer = os.waitstatus_to_exitcode(status) if done else Nursery.RUNNING
        own.send(struct.pack(">q", answer))


if __name__ == "__main__":
    _main(socket.socket(fileno=int(sys.argv[1])))
