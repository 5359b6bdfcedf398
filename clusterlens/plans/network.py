"""Services, endpoint slices and ingresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from clusterlens.functions.ids import uuid5
from clusterlens.functions.text import nullable, text
from clusterlens.plans.common import (
    Kind,
    Relation,
    bridge,
    conditions,
    dictionary,
    document,
    exploded,
    flag,
    header,
    tagging,
    zero,
)


def _c(path: str) -> Column:
    return F.col(path)


def _joined(values: Column) -> Column:
    return F.coalesce(F.array_join(values, ", "), F.lit(""))


# --------------------------------------------------------------------------- service


def ip_families(families: Column) -> Column:
    """Stack of a service; NULL if it lists no family."""
    v4, v6 = flag(F.array_contains(families, "IPv4")), flag(F.array_contains(families, "IPv6"))
    stack = F.when(v4 & v6, "DualStack").when(v4, "IPv4").when(v6, "IPv6").otherwise("Unknown")
    return F.when(F.array_size(families) > 0, stack)


def service(objects: DataFrame, now: Column) -> DataFrame:
    return objects.select(
        *header(),
        text(_c("spec.clusterIP")).alias("cluster_ip"),
        _joined(_c("spec.clusterIPs")).alias("cluster_ips"),
        text(_c("spec.type")).alias("type"),
        nullable(_joined(_c("spec.externalIPs"))).alias("external_ips"),
        text(_c("spec.sessionAffinity")).alias("session_affinity"),
        nullable(_c("spec.externalName")).alias("external_name"),
        nullable(_c("spec.externalTrafficPolicy")).alias("external_traffic_policy"),
        F.nullif(_c("spec.healthCheckNodePort"), F.lit(0)).alias("health_check_node_port"),
        flag(_c("spec.publishNotReadyAddresses")).alias("publish_not_ready_addresses"),
        ip_families(_c("spec.ipFamilies")).alias("ip_families"),
        nullable(_c("spec.ipFamilyPolicy")).alias("ip_family_policy"),
        flag(_c("spec.allocateLoadBalancerNodePorts"), True).alias("allocate_load_balancer_node_ports"),
        _c("spec.loadBalancerClass").alias("load_balancer_class"),
        F.coalesce(_c("spec.internalTrafficPolicy"), F.lit("Cluster")).alias("internal_traffic_policy"),
        document(objects),
    )


def service_ports(objects: DataFrame) -> DataFrame:
    return exploded(objects, "spec.ports", _c("uuid").alias("service_uuid"), names=("p",)).select(
        "service_uuid",
        text(_c("p.name")).alias("name"),
        text(_c("p.protocol")).alias("protocol"),
        text(_c("p.appProtocol")).alias("app_protocol"),
        zero(_c("p.port")).alias("port"),
        # An absent target is the number 0.
        F.coalesce(_c("p.targetPort"), F.lit("0")).alias("target_port"),
        zero(_c("p.nodePort")).alias("node_port"),
    )


# --------------------------------------------------------------------------- endpoint slice


def endpoint_slice(objects: DataFrame, now: Column) -> DataFrame:
    return objects.select(*header(), text(_c("addressType")).alias("address_type"))


def endpoints(objects: DataFrame) -> DataFrame:
    """One row per endpoint, port and address of a slice."""
    found = exploded(objects, "endpoints", _c("uuid").alias("slice"), "ports", names=("e",))
    found = exploded(found, "ports", "slice", "e", names=("p",))
    found = exploded(found, "e.addresses", "slice", "e", "p", names=("address",))
    port_name, port = text(_c("p.name")), zero(_c("p.port"))
    return found.select(
        uuid5(_c("slice"), F.concat(port_name, _c("address"), port.cast("string"))).alias("uuid"),
        _c("slice").alias("endpoint_slice_uuid"),
        text(_c("e.hostname")).alias("host_name"),
        text(_c("e.nodeName")).alias("node_name"),
        _c("e.conditions.ready").alias("ready"),
        _c("e.conditions.serving").alias("serving"),
        _c("e.conditions.terminating").alias("terminating"),
        "address",
        text(_c("p.protocol")).alias("protocol"),
        port.alias("port"),
        port_name.alias("port_name"),
        text(_c("p.appProtocol")).alias("app_protocol"),
    )


def target_refs(objects: DataFrame) -> DataFrame:
    found = exploded(objects, "endpoints", _c("uuid").alias("endpoint_slice_uuid"), names=("e",))
    return found.select("endpoint_slice_uuid", _c("e.targetRef").alias("t")).select(
        "endpoint_slice_uuid",
        nullable(_c("t.kind")).alias("kind"),
        text(_c("t.namespace")).alias("namespace"),
        text(_c("t.name")).alias("name"),
        text(_c("t.uid")).alias("uid"),
        text(_c("t.apiVersion")).alias("api_version"),
        text(_c("t.resourceVersion")).alias("resource_version"),
    )


# --------------------------------------------------------------------------- ingress


def ingress(objects: DataFrame, now: Column) -> DataFrame:
    return objects.select(*header(), document(objects))


def ingress_tls(objects: DataFrame) -> DataFrame:
    found = exploded(objects, "spec.tls", _c("uuid").alias("ingress_uuid"), names=("t",))
    return exploded(found, "t.hosts", "ingress_uuid", text(_c("t.secretName")).alias("tls_secret"), names=("tls_host",))


def _paths(objects: DataFrame) -> DataFrame:
    """Rule paths with a backend; a service wins over a resource."""
    rules = exploded(objects, "spec.rules", _c("uuid").alias("ingress_uuid"), names=("r",))
    paths = (
        exploded(rules, "r.http.paths", "ingress_uuid", text(_c("r.host")).alias("host"), names=("p",))
        .select(
            "ingress_uuid",
            "host",
            text(_c("p.path")).alias("path"),
            text(_c("p.pathType")).alias("path_type"),
            _c("p.backend.service").alias("service"),
            _c("p.backend.resource").alias("resource"),
        )
        .where(_c("service").isNotNull() | _c("resource").isNotNull())
    )
    target = F.when(_c("service").isNotNull(), text(_c("service.name"))).otherwise(text(_c("resource.name")))
    rule = uuid5(_c("ingress_uuid"), F.concat("host", "path", target))
    return paths.withColumn("rule_uuid", rule).withColumn("backend_uuid", uuid5(_c("rule_uuid"), target))


def _service_backend(key: Column, rule: Column, service: Column) -> list[Column]:
    return [
        key.alias("service_uuid"),
        _c("ingress_uuid"),
        rule.alias("ingress_rule_uuid"),
        text(service["name"]).alias("service_name"),
        text(service["port"]["name"]).alias("service_port_name"),
        zero(service["port"]["number"]).alias("service_port_number"),
    ]


def _resource_backend(key: Column, rule: Column, resource: Column) -> list[Column]:
    return [
        key.alias("resource_uuid"),
        _c("ingress_uuid"),
        rule.alias("ingress_rule_uuid"),
        resource["apiGroup"].alias("api_group"),
        text(resource["kind"]).alias("kind"),
        text(resource["name"]).alias("name"),
    ]


def _defaults(objects: DataFrame) -> DataFrame:
    return objects.select(
        _c("uuid").alias("ingress_uuid"),
        _c("spec.defaultBackend.service").alias("service"),
        _c("spec.defaultBackend.resource").alias("resource"),
    )


def backend_services(objects: DataFrame) -> DataFrame:
    none = F.lit(None).cast("string")
    key = uuid5(_c("ingress_uuid"), F.concat(text(_c("service.name")), text(_c("service.port.name"))))
    default = _defaults(objects).where(_c("service").isNotNull()).select(*_service_backend(key, none, _c("service")))
    ruled = _paths(objects).where(_c("service").isNotNull())
    return default.unionByName(ruled.select(*_service_backend(_c("backend_uuid"), _c("rule_uuid"), _c("service"))))


def backend_resources(objects: DataFrame) -> DataFrame:
    """A default backend resource counts only with an API group."""
    none = F.lit(None).cast("string")
    key = uuid5(_c("ingress_uuid"), F.concat(text(_c("resource.kind")), text(_c("resource.name"))))
    default = (
        _defaults(objects)
        .where(_c("resource.apiGroup").isNotNull())
        .select(*_resource_backend(key, none, _c("resource")))
    )
    ruled = _paths(objects).where(_c("service").isNull())
    return default.unionByName(ruled.select(*_resource_backend(_c("backend_uuid"), _c("rule_uuid"), _c("resource"))))


def ingress_rules(objects: DataFrame) -> DataFrame:
    return _paths(objects).select(
        _c("rule_uuid").alias("uuid"),
        "backend_uuid",
        "ingress_uuid",
        nullable(_c("host")).alias("host"),
        nullable(_c("path")).alias("path"),
        "path_type",
    )


def kinds() -> list[Kind]:
    service_fk, slice_fk, ingress_fk = "service_uuid", "endpoint_slice_uuid", "ingress_uuid"
    return [
        Kind(
            "service",
            service,
            (
                conditions("service"),
                Relation("service_port", service_fk, (service_fk, "name"), service_ports),
                Relation("selector", "uuid", ("uuid",), dictionary("spec.selector"), cascade=False),
                Relation(
                    "service_selector",
                    service_fk,
                    (service_fk, "selector_uuid"),
                    bridge("spec.selector", service_fk, "selector_uuid"),
                ),
                *tagging("service"),
                Relation("service_pod", service_fk, (service_fk, "pod_uuid")),
            ),
        ),
        Kind(
            "endpoint_slice",
            endpoint_slice,
            (
                Relation("endpoint", slice_fk, ("uuid",), endpoints),
                *tagging("endpoint_slice", annotations=False, resource=False, favorite=False),
                # Wider than one row per slice: every endpoint has a target.
                Relation("endpoint_target_ref", slice_fk, (slice_fk, "uid"), target_refs),
            ),
        ),
        Kind(
            "ingress",
            ingress,
            (
                # Wider than one row per ingress: several hosts may be listed.
                Relation("ingress_tls", ingress_fk, (ingress_fk, "tls_host"), ingress_tls),
                Relation("ingress_backend_service", ingress_fk, (service_fk, ingress_fk), backend_services),
                Relation("ingress_backend_resource", ingress_fk, ("resource_uuid", ingress_fk), backend_resources),
                Relation("ingress_rule", ingress_fk, ("uuid",), ingress_rules),
                *tagging("ingress"),
            ),
        ),
    ]
