"""What runs between the steps of training, and logging.

A callback has four methods, called with the training state: a dictionary with ``model``, ``num_iter``, ``train`` and
``valid`` (frames with margins), ``iter_score`` and more. ``after_iteration`` returns whether training should stop.
"""

from __future__ import annotations

import logging
import sys

log = logging.getLogger("larkspur")
#: Levels between the standard ones, for verbosity 3 and 2 (fixed values).
INFO2, INFO3 = 17, 13


def verbosity_to_loglevel(verbosity: int) -> int:
    """0 and below: errors only; then warnings and progress, then two finer levels, then everything."""
    if verbosity <= 0:
        return logging.ERROR
    return {1: logging.INFO, 2: INFO2, 3: INFO3}.get(verbosity, logging.DEBUG)


class DuplicateFilter(logging.Filter):
    """Lets every message through once."""

    def __init__(self):
        super().__init__()
        self.seen: set[str] = set()

    def filter(self, record: logging.LogRecord) -> bool:
        new = record.getMessage() not in self.seen
        self.seen.add(record.getMessage())
        return new


class LoggerStream:
    """A writable that hands complete lines to a logger."""

    def __init__(self, logger: logging.Logger = log, level: int = logging.INFO):
        self.logger, self.level, self.rest = logger, level, ""

    def write(self, text: str) -> None:
        *lines, self.rest = (self.rest + text).split("\n")
        for line in lines:
            if line.strip():
                self.logger.log(self.level, line)

    def flush(self) -> None:
        if self.rest.strip():
            self.logger.log(self.level, self.rest)
        self.rest = ""


def set_stdout_level(level: int) -> None:
    if not any(getattr(h, "stream", None) is sys.stdout for h in log.handlers):
        log.addHandler(logging.StreamHandler(sys.stdout))
    log.setLevel(level)


def add_filehandler(path: str, level: int = logging.DEBUG) -> None:
    handler = logging.FileHandler(path)
    handler.setLevel(level)
    log.addHandler(handler)


class Callback:
    def before_train(self, state: dict) -> None: ...

    def before_iteration(self, state: dict) -> None: ...

    def after_iteration(self, state: dict) -> bool:
        return False

    def after_train(self, state: dict) -> None: ...


class CallbackPipeline(Callback):
    """Callbacks in order. Once one asks to stop, those behind it are not asked in that iteration."""

    def __init__(self, *callbacks: Callback):
        self.callbacks = callbacks

    def before_train(self, state):
        for c in self.callbacks:
            c.before_train(state)

    def before_iteration(self, state):
        for c in self.callbacks:
            c.before_iteration(state)

    def after_iteration(self, state):
        return any(c.after_iteration(state) for c in self.callbacks)

    def after_train(self, state):
        for c in self.callbacks:
            c.after_train(state)


class EvalHistory(Callback):
    """The metric of every evaluation set after every iteration; logged every ``verbose`` iterations (0: never)."""

    def __init__(self, verbose: int = 10):
        self.verbose = verbose

    def before_train(self, state):
        self.history: list[list[float]] = []

    def after_iteration(self, state):
        metric, loss = state["metric"], state["model"].loss
        scores = []
        for rows in state["valid"]:
            scores.append(metric.evaluate(rows.withColumn("_p", loss.postprocess(rows["pred"])), "y", "_p", "w" if state["weighted"] else None))
        self.history.append(scores)
        state["iter_score"] = scores
        if self.verbose and scores and state["num_iter"] % self.verbose == 0:
            log.info("Iter %d; %s", state["num_iter"], "; ".join(f"set {k}: {s:g}" for k, s in enumerate(scores)))
        return False


class EarlyStopping(Callback):
    """Stops after ``num_rounds`` iterations without a better score of the last evaluation set, and cuts the model to
    its best iteration, whether it stopped or not; 0 turns it off."""

    def __init__(self, num_rounds: int = 100):
        self.num_rounds = num_rounds

    def before_train(self, state):
        self.best_score, self.best_round, self.misses = None, 0, 0

    def after_iteration(self, state):
        scores = state.get("iter_score")
        if not self.num_rounds or not scores:
            return False
        if self.best_score is None or state["metric"].compare(scores[-1], self.best_score):
            self.best_score, self.best_round, self.misses = scores[-1], state["num_iter"] + 1, 0
        else:
            self.misses += 1
        return self.misses >= self.num_rounds

    def after_train(self, state):
        if self.best_score is not None:
            del state["model"].trees[self.best_round :]
            log.info("Best round %d, score %g", self.best_round, self.best_score)
