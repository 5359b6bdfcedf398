"""Health classifiers.

Each classifier turns the columns of one object into ``struct<rank, reason>`` with
ordered ``when`` branches, so it is evaluated inside the scan stage of the object
and never shuffles.  ``now`` is always passed in.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from clusterlens.functions.state import CRITICAL, OK, PENDING, UNKNOWN, WARNING, state_name, tagged_reason, verdict
from clusterlens.functions.text import reason_and_message, rfc3339, strip_stop, text, time_text

# The reason texts.
CONTAINER_PROBE_FAILED = (
    "Container %s is critical as it's not ready due to failing %s probes."
    " Last terminal with non-zero exit code %d and signal %d was at %s. %s."
)
CONTAINER_DONE = "Container %s terminated successfully at %s."
CONTAINER_SIGNALLED = "Container %s terminated with signal %d at %s. %s."
CONTAINER_EXITED = "Container %s terminated with non-zero exit code %d at %s. %s."
CONTAINER_PENDING = "Container %s is pending."
CONTAINER_RUNNING = "Container %s is running since %s."
CONTAINER_WAITING = "Container %s is pending as it's waiting to be started."
CONTAINER_POD_INIT = "Container %s is pending as the Pod it's running on is initializing."
CONTAINER_CREATING = "Container %s is pending as it's still being created."
CONTAINER_NO_START = "Container %s cannot start. %s."
CONTAINER_NO_IMAGE = "Container %s is waiting to start as its image cannot be pulled: %s."
CONTAINER_NO_STATE = "Container %s is unknown as its state could not be obtained: No state provided."

POD_NODE_LOST = "Pod %s/%s is unknown as the node which was running the pod is unresponsive."
POD_DELETED = "Pod %s/%s is being deleted at %s."
POD_TERMINAL = "Pod %s/%s is terminal: %s: %s."
POD_SUCCEEDED = (
    "Pod %s/%s is succeeded as all its containers have been terminated successfully and will not be restarted."
)
POD_UNSCHEDULED = "Pod %s/%s cannot be scheduled: %s: %s."
POD_FAILED = "Pod %s/%s has failed as all its containers have been terminated and will not be restarted.\n%s"
POD_NOT_STARTABLE = "Pod %s/%s is not ready to start containers."
POD_IS = "Pod %s/%s is %s.\n%s"
POD_RUNNING = "Pod %s/%s is %s with %d out of %d containers running.\n%s"

NODE_DISK = "Node %s is running out of disk space"
NODE_MEMORY = "Node %s is running out of available memory"
NODE_PIDS = "Node %s is running out of process IDs"
NODE_NETWORK = "Node %s network is not correctly configured"
NODE_NOT_READY = "Node %s has 'NodeReady' condition 'false'"
NODE_UNREACHABLE = "Node %s has 'NodeReady' condition 'unknown'"
NODE_OK = "Node %s is ok."

DEPLOYMENT_NOT_AVAILABLE = "Deployment %s/%s is not available: %s."
DEPLOYMENT_REPLICA_FAILURE = "Deployment %s/%s has replica failure: %s."
DEPLOYMENT_UNAVAILABLE = "Deployment %s/%s has %d unavailable replicas."
REPLICAS_SOME = "%s %s/%s only has %d out of %d desired replicas available."
REPLICAS_ALL = "%s %s/%s has all %d desired replicas available."
REPLICAS_NONE = "%s %s/%s has no replica available from %d desired."
REPLICA_SET_FAILURE = "ReplicaSet %s/%s has a failure condition: %s."
DAEMON_SET_INVALID = "DaemonSet %s/%s has an invalid desired node count: %d."
DAEMON_SET_NONE = (
    "DaemonSet %s/%s does not have a single pod available which should run on %d desired nodes."
)
DAEMON_SET_SOME = "DaemonSet %s/%s pods are only available on %d out of %d desired nodes."
DAEMON_SET_ALL = "DaemonSet %s/%s has pods available on all %d desired nodes."

JOB_CRITERIA_MET = "Job %s/%s met its sucess criteria."
JOB_COMPLETE = "Job %s/%s has completed its execution successfully with %s."
JOB_FAILED = "Job %s/%s has failed its execution. %s: %s."
JOB_FAILING = "Job %s/%s is about to fail its execution. %s: %s."
JOB_SUSPENDED = "Job %s/%s is suspended."
JOB_RUNNING = (
    "Job %s/%s is running since %s with currently %d active, %d completed and %d failed pods."
    " Successful termination requires %s. The back-off limit is %s.%s"
)
JOB_DEADLINE = " Deadline for completion is %d."

CRON_NEVER_SCHEDULED = "CronJob %s has never been scheduled."
CRON_NEVER_SUCCEEDED = "CronJob %s has never completed successfully."
CRON_MISSED = "CronJob %s missed its starting deadline. Last scheduled at %s, deadline was %s."
CRON_BEHIND = "CronJob %s has recent schedules without success. Last successful run: %s, last scheduled: %s."
CRON_SUSPENDED = "CronJob %s is currently suspended."
CRON_OK = "CronJob %s is operating normally. Last successful run: %s."


def _count(value: Column) -> Column:
    return F.coalesce(value, F.lit(0)).cast("bigint")


def _first(*branches: tuple[Column, Column], otherwise: Column) -> Column:
    """Ordered decision table: the first branch whose condition is true wins (NULL is not true)."""
    decided = None
    for condition, outcome in branches:
        decided = F.when(condition, outcome) if decided is None else decided.when(condition, outcome)
    return decided.otherwise(otherwise)


# --------------------------------------------------------------------------- containers


def container_verdict(container: Column, status: Column) -> Column:
    """Health of one container from its spec and its (possibly NULL) status."""
    name = text(container["name"])
    state, last = status["state"], status["lastState"]["terminated"]
    ended, running, waiting = state["terminated"], state["running"], state["waiting"]
    ready = F.coalesce(status["ready"], F.lit(False))
    started = F.coalesce(status["started"], F.lit(False))

    def probe_failed(kind: str) -> Column:
        return verdict(
            CRITICAL,
            F.format_string(
                CONTAINER_PROBE_FAILED,
                name,
                F.lit(kind),
                _count(last["exitCode"]),
                _count(last["signal"]),
                time_text(last["finishedAt"]),
                reason_and_message(last["reason"], last["message"]),
            ),
        )

    def no_start(cause: Column) -> Column:
        # The message loses up to two full stops, one here and one when joined to its reason.
        detail = reason_and_message(cause["reason"], strip_stop(cause["message"]))
        return verdict(CRITICAL, F.format_string(CONTAINER_NO_START, name, detail))

    unready = ~ready & container["readinessProbe"].isNotNull() & last.isNotNull()
    unstarted = container["startupProbe"].isNotNull() & last.isNotNull()
    pending = verdict(PENDING, F.format_string(CONTAINER_PENDING, name))
    cause = reason_and_message(ended["reason"], ended["message"])
    wait_reason = text(waiting["reason"])

    terminated = _first(
        (unready, probe_failed("readiness")),
        (
            _count(ended["exitCode"]) == 0,
            verdict(OK, F.format_string(CONTAINER_DONE, name, time_text(ended["finishedAt"]))),
        ),
        (
            _count(ended["signal"]) != 0,
            verdict(
                CRITICAL,
                F.format_string(
                    CONTAINER_SIGNALLED, name, _count(ended["signal"]), time_text(ended["finishedAt"]), cause
                ),
            ),
        ),
        otherwise=verdict(
            CRITICAL,
            F.format_string(CONTAINER_EXITED, name, _count(ended["exitCode"]), time_text(ended["finishedAt"]), cause),
        ),
    )
    up = _first(
        (~started & unstarted, probe_failed("startup")),
        (~started, pending),
        (unready, probe_failed("readiness")),
        (~ready, pending),
        otherwise=verdict(OK, F.format_string(CONTAINER_RUNNING, name, time_text(running["startedAt"]))),
    )
    held = _first(
        (wait_reason == "", verdict(PENDING, F.format_string(CONTAINER_WAITING, name))),
        (wait_reason == "PodInitializing", verdict(PENDING, F.format_string(CONTAINER_POD_INIT, name))),
        (wait_reason == "ContainerCreating", verdict(PENDING, F.format_string(CONTAINER_CREATING, name))),
        ((wait_reason == "ErrImagePull") & (last["reason"] == "ImagePullBackOff"), no_start(last)),
        (
            wait_reason == "ErrImagePull",
            verdict(WARNING, F.format_string(CONTAINER_NO_IMAGE, name, text(waiting["message"]))),
        ),
        otherwise=no_start(waiting),
    )
    return _first(
        (ended.isNotNull(), terminated),
        (running.isNotNull(), up),
        (waiting.isNotNull(), held),
        otherwise=verdict(UNKNOWN, F.format_string(CONTAINER_NO_STATE, name)),
    )


def container_fold(containers: Column) -> Column:
    """Roll an ordered array of classified containers up, inside the row.

    The elements carry ``role`` and ``health`` (rank, reason).  The result is
    ``struct<rank, reasons, not_ok, not_ok_main, total>``; the last two leave init containers out.
    """

    def bad(c: Column) -> Column:
        return c["health"]["rank"] > OK

    def main(c: Column) -> Column:
        return c["role"] != "init"

    tagged = F.transform(containers, lambda c: tagged_reason(c["health"]["rank"], c["health"]["reason"]))
    return F.struct(
        F.coalesce(F.array_max(F.transform(containers, lambda c: c["health"]["rank"])), F.lit(OK)).alias("rank"),
        F.array_join(tagged, "\n").alias("reasons"),
        F.size(F.filter(containers, bad)).alias("not_ok"),
        F.size(F.filter(containers, lambda c: bad(c) & main(c))).alias("not_ok_main"),
        F.size(F.filter(containers, main)).alias("total"),
    )


# --------------------------------------------------------------------------- pods


def last_condition(conditions: Column, kind: str) -> Column:
    """The last condition of a type (later duplicates win), NULL if there is none."""
    found = F.filter(conditions, lambda c: c["type"] == kind)
    return F.try_element_at(found, F.lit(-1))


def pod_shut_down(metadata: Column, now: Column) -> Column:
    """Deleted by force, finished by its node, or stuck beyond its grace period."""
    deleted, grace = metadata["deletionTimestamp"], metadata["deletionGracePeriodSeconds"]
    over = now > deleted + F.make_dt_interval(secs=grace.cast("decimal(18,6)"))
    return F.coalesce(deleted.isNotNull() & grace.isNotNull() & ((grace == 0) | over), F.lit(False))


def pod_evicted(status: Column) -> Column:
    return F.coalesce((status["phase"] == "Failed") & (status["reason"] == "Evicted"), F.lit(False))


def pod_verdict(
    metadata: Column, status: Column, fold: Column, now: Column, *, strict_counts: bool = False
) -> Column:
    """Health of a pod.

    ``fold`` is :func:`container_fold` of its containers.  By default the running count
    takes failing init containers off although the total leaves them out;
    ``strict_counts`` takes off only those the total counts.
    """
    namespace, name = text(metadata["namespace"]), text(metadata["name"])
    conditions = status["conditions"]
    disrupted = last_condition(conditions, "DisruptionTarget")
    scheduled = last_condition(conditions, "PodScheduled")
    idle = fold["not_ok_main"] if strict_counts else fold["not_ok"]

    def say(rank: int | Column, template: str, *args: Column) -> Column:
        return verdict(rank, F.format_string(template, namespace, name, *args))

    def is_false(kind: str) -> Column:
        return last_condition(conditions, kind)["status"] == "False"

    return _first(
        (status["reason"] == "NodeLost", say(UNKNOWN, POD_NODE_LOST)),
        (pod_shut_down(metadata, now), say(OK, POD_DELETED, time_text(metadata["deletionTimestamp"]))),
        (
            pod_evicted(status),
            say(CRITICAL, POD_TERMINAL, text(status["reason"]), strip_stop(status["message"])),
        ),
        (
            disrupted.isNotNull(),
            say(CRITICAL, POD_TERMINAL, text(disrupted["reason"]), strip_stop(disrupted["message"])),
        ),
        (status["phase"] == "Succeeded", say(OK, POD_SUCCEEDED)),
        (
            scheduled["status"] == "False",
            say(CRITICAL, POD_UNSCHEDULED, text(scheduled["reason"]), text(scheduled["message"])),
        ),
        (status["phase"] == "Failed", say(fold["rank"], POD_FAILED, fold["reasons"])),
        (is_false("PodReadyToStartContainers"), say(CRITICAL, POD_NOT_STARTABLE)),
        (
            is_false("Initialized") | is_false("ContainersReady") | is_false("Ready"),
            say(fold["rank"], POD_IS, state_name(fold["rank"]), fold["reasons"]),
        ),
        otherwise=say(
            fold["rank"],
            POD_RUNNING,
            state_name(fold["rank"]),
            fold["total"] - idle,
            fold["total"],
            fold["reasons"],
        ),
    )


# --------------------------------------------------------------------------- nodes


def condition_holds(conditions: Column, kind: str) -> Column:
    """Is any condition of the type true?"""
    held = F.exists(conditions, lambda c: (c["type"] == kind) & (c["status"] == "True"))
    return F.coalesce(held, F.lit(False))


def node_verdict(name: Column, conditions: Column) -> Column:
    """Health of a node: the last condition that says anything decides, all of them explain."""
    name = text(name)

    def finding(condition: Column) -> Column:
        on = condition["status"] == "True"
        kind = condition["type"]

        def say(rank: int, template: str) -> Column:
            return verdict(rank, F.format_string(template, name))

        ready = kind == "Ready"
        return (
            F.when((kind == "DiskPressure") & on, say(CRITICAL, NODE_DISK))
            .when((kind == "MemoryPressure") & on, say(CRITICAL, NODE_MEMORY))
            .when((kind == "PIDPressure") & on, say(CRITICAL, NODE_PIDS))
            .when((kind == "NetworkUnavailable") & on, say(CRITICAL, NODE_NETWORK))
            .when(ready & (condition["status"] == "False"), say(CRITICAL, NODE_NOT_READY))
            .when(ready & (condition["status"] == "Unknown"), say(UNKNOWN, NODE_UNREACHABLE))
        )

    findings = F.filter(F.transform(conditions, finding), lambda f: f.isNotNull())
    reasons = F.array_join(F.transform(findings, lambda f: f["reason"]), ". ")
    return F.when(
        F.size(findings) > 0,
        verdict(F.try_element_at(findings, F.lit(-1))["rank"], F.concat(reasons, F.lit("."))),
    ).otherwise(verdict(OK, F.format_string(NODE_OK, name)))


# --------------------------------------------------------------------------- workloads


def deployment_verdict(
    namespace: Column,
    name: Column,
    desired: Column,
    available: Column,
    unavailable: Column,
    conditions: Column | None = None,
    *,
    use_conditions: bool = False,
) -> Column:
    """Health of a deployment; its conditions are looked at only on request."""
    ns, nm = text(namespace), text(name)
    want, have, missing = _count(desired), _count(available), _count(unavailable)
    branches = [
        (missing > 0, verdict(CRITICAL, F.format_string(DEPLOYMENT_UNAVAILABLE, ns, nm, missing))),
        (have < want, verdict(WARNING, F.format_string(REPLICAS_SOME, F.lit("Deployment"), ns, nm, have, want))),
    ]
    if use_conditions:
        bad = F.try_element_at(
            F.filter(
                conditions,
                lambda c: ((c["type"] == "Available") & (c["status"] != "True"))
                | ((c["type"] == "ReplicaFailure") & (c["status"] == "True")),
            ),
            F.lit(1),
        )
        message = text(bad["message"])
        branches = [
            (
                bad["type"] == "Available",
                verdict(CRITICAL, F.format_string(DEPLOYMENT_NOT_AVAILABLE, ns, nm, message)),
            ),
            (
                bad["type"] == "ReplicaFailure",
                verdict(CRITICAL, F.format_string(DEPLOYMENT_REPLICA_FAILURE, ns, nm, message)),
            ),
            *branches,
        ]
    return _first(
        *branches, otherwise=verdict(OK, F.format_string(REPLICAS_ALL, F.lit("Deployment"), ns, nm, want))
    )


def daemon_set_verdict(namespace: Column, name: Column, desired: Column, available: Column) -> Column:
    ns, nm = text(namespace), text(name)
    want, have = _count(desired), _count(available)
    return _first(
        (want < 1, verdict(UNKNOWN, F.format_string(DAEMON_SET_INVALID, ns, nm, want))),
        (have == 0, verdict(CRITICAL, F.format_string(DAEMON_SET_NONE, ns, nm, want))),
        (have < want, verdict(WARNING, F.format_string(DAEMON_SET_SOME, ns, nm, have, want))),
        otherwise=verdict(OK, F.format_string(DAEMON_SET_ALL, ns, nm, want)),
    )


def replica_set_verdict(
    namespace: Column,
    name: Column,
    desired: Column,
    available: Column,
    conditions: Column | None = None,
    *,
    use_conditions: bool = False,
) -> Column:
    ns, nm, kind = text(namespace), text(name), F.lit("ReplicaSet")
    want, have = _count(desired), _count(available)
    branches = [
        ((have < 1) & (want > 0), verdict(CRITICAL, F.format_string(REPLICAS_NONE, kind, ns, nm, want))),
        (have < want, verdict(WARNING, F.format_string(REPLICAS_SOME, kind, ns, nm, have, want))),
    ]
    if use_conditions:
        failed = F.try_element_at(
            F.filter(conditions, lambda c: (c["type"] == "ReplicaFailure") & (c["status"] == "True")), F.lit(1)
        )
        reason = F.format_string(REPLICA_SET_FAILURE, ns, nm, text(failed["message"]))
        branches.insert(0, (failed.isNotNull(), verdict(CRITICAL, reason)))
    return _first(*branches, otherwise=verdict(OK, F.format_string(REPLICAS_ALL, kind, ns, nm, want)))


def stateful_set_verdict(namespace: Column, name: Column, desired: Column, available: Column) -> Column:
    """No available replica is critical even if none is desired."""
    ns, nm, kind = text(namespace), text(name), F.lit("StatefulSet")
    want, have = _count(desired), _count(available)
    return _first(
        (have == 0, verdict(CRITICAL, F.format_string(REPLICAS_NONE, kind, ns, nm, want))),
        (have < want, verdict(WARNING, F.format_string(REPLICAS_SOME, kind, ns, nm, have, want))),
        otherwise=verdict(OK, F.format_string(REPLICAS_ALL, kind, ns, nm, want)),
    )


JOB_DECISIVE = ("SuccessCriteriaMet", "Complete", "Failed", "FailureTarget", "Suspended")


def job_verdict(metadata: Column, spec: Column, status: Column) -> Column:
    """Health of a job: the first true condition that decides anything, else pending."""
    ns, nm = text(metadata["namespace"]), text(metadata["name"])
    decisive = F.try_element_at(
        F.filter(status["conditions"], lambda c: (c["status"] == "True") & c["type"].isin(*JOB_DECISIVE)), F.lit(1)
    )
    kind, reason, message = decisive["type"], text(decisive["reason"]), text(decisive["message"])
    completions = spec["completions"].cast("bigint")
    done_with = F.when(
        completions.isNotNull(), F.format_string("%d necessary pod completions", completions)
    ).otherwise("any pod completion")
    needs = F.when(completions.isNotNull(), F.format_string("%d pod completions", completions)).otherwise(
        "any pod completion"
    )
    deadline = spec["activeDeadlineSeconds"].cast("bigint")
    running = F.format_string(
        JOB_RUNNING,
        ns,
        nm,
        F.when(status["startTime"].isNull(), "<nil>").otherwise(time_text(status["startTime"])),
        _count(status["active"]),
        _count(status["succeeded"]),
        _count(status["failed"]),
        needs,
        F.coalesce(spec["backoffLimit"].cast("string"), F.lit("<nil>")),
        F.when(deadline.isNotNull(), F.format_string(JOB_DEADLINE, deadline)).otherwise(""),
    )
    return _first(
        (kind == "SuccessCriteriaMet", verdict(OK, F.format_string(JOB_CRITERIA_MET, ns, nm))),
        (kind == "Complete", verdict(OK, F.format_string(JOB_COMPLETE, ns, nm, done_with))),
        (kind == "Failed", verdict(CRITICAL, F.format_string(JOB_FAILED, ns, nm, reason, message))),
        (kind == "FailureTarget", verdict(WARNING, F.format_string(JOB_FAILING, ns, nm, reason, message))),
        (kind == "Suspended", verdict(OK, F.format_string(JOB_SUSPENDED, ns, nm))),
        otherwise=verdict(PENDING, running),
    )


def cron_job_verdict(
    name: Column, scheduled: Column, succeeded: Column, deadline_seconds: Column, suspended: Column, now: Column
) -> Column:
    nm = text(name)
    deadline = scheduled + F.make_dt_interval(secs=deadline_seconds.cast("decimal(18,6)"))
    return _first(
        (scheduled.isNull(), verdict(WARNING, F.format_string(CRON_NEVER_SCHEDULED, nm))),
        (succeeded.isNull(), verdict(CRITICAL, F.format_string(CRON_NEVER_SUCCEEDED, nm))),
        (
            now > deadline,
            verdict(CRITICAL, F.format_string(CRON_MISSED, nm, rfc3339(scheduled), rfc3339(deadline))),
        ),
        (
            scheduled > succeeded,
            verdict(WARNING, F.format_string(CRON_BEHIND, nm, rfc3339(succeeded), rfc3339(scheduled))),
        ),
        (suspended, verdict(WARNING, F.format_string(CRON_SUSPENDED, nm))),
        otherwise=verdict(OK, F.format_string(CRON_OK, nm, rfc3339(succeeded))),
    )
