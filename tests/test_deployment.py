"""Deployment descriptors on hand-made files."""

import pytest

from graphloom.sources import deployment as D

COMPOSE = '''services:
  web:
    build: {context: ./src, dockerfile: D}
    ports: ["80:8080", {published: 443, target: 8443}]
    environment:
      - A__B=1
      - PASSWORD
    depends_on:
      db: {condition: service_healthy}
    networks: [front]
  db:
    image: "docker.io/library/postgres:16"
    environment: {POSTGRES_USER: x}
    volumes: [data:/var, {source: s, target: t}]
---
services: [not, a, mapping]
'''
KUBE = '''# a comment first
apiVersion: apps/v1
kind: Deployment
metadata: {name: api}
spec:
  template:
    spec:
      containers:
        - image: shop/api:1
          ports: [{containerPort: 80}]
          env: [{name: KEY, value: secret}, {name: OTHER}]
        - image: redis:7
      volumes: [{name: cache}]
---
kind: Service
metadata: {name: api}
spec:
  ports: [{port: 80, targetPort: 8080}, {port: 90}]
---
kind: CronJob
metadata: {name: nightly}
spec: {jobTemplate: {spec: {template: {spec: {containers: [{image: job}]}}}}}
---
kind: ConfigMap
metadata: {name: x}
---
'''


def test_units(spark):
    pytest.importorskip("yaml")
    files = [("compose.yml", COMPOSE), ("k8s/a.yaml", KUBE), ("helm.yaml", "a: {{ .Values.x }}\n  b: ["), ("n.yaml", None), ("e.yml", ""), ("x.txt", COMPOSE)]
    got = {r.unit: r for r in D.deployment_units(spark.createDataFrame(files, "file string, text string")).collect()}
    assert set(got) == {"web", "db", "Deployment/api", "Service/api", "CronJob/nightly"}
    assert tuple(got["web"])[1:] == (2, "web", None, "./src", ["80:8080", "443:8443"], ["A__B", "PASSWORD"], ["db"], [], ["front"])
    assert tuple(got["db"])[1:] == (11, "db", "docker.io/library/postgres:16", None, [], ["POSTGRES_USER"], [], ["data:/var", "s:t"], [])
    assert tuple(got["Deployment/api"])[1:] == (2, "Deployment/api", "shop/api:1, redis:7", None, ["80"], ["KEY", "OTHER"], [], ["cache"], [])
    assert got["Service/api"].ports == ["80→8080", "90→90"] and got["CronJob/nightly"].image == "job"


def test_images_and_resources(spark):
    files = [("a/Dockerfile", "FROM --platform=x node:20 AS b\nRUN x\nfrom node:20\nFROM nginx\nEXPOSE 80 443/tcp\n expose 9\n# FROM no"), ("m.tf", 'resource "azurerm_redis_cache" "c" {\n}\n  resource "azurerm_redis_cache" "d" {'), ("m.bicep", "resource db 'Microsoft.DBforPostgreSQL/flexibleServers@2022-12-01' = {"), ("x.Dockerfile", None)]
    df = spark.createDataFrame(files, "file string, text string")
    assert [(r.file, r.bases, r.exposes) for r in D.image_stages(df).where("bases is not null").collect()] == [("a/Dockerfile", ["node:20", "nginx"], ["80", "443/tcp", "9"])]
    assert sorted(tuple(r) for r in D.resources(df).collect()) == [("m.bicep", "Microsoft.DBforPostgreSQL/flexibleServers", 1), ("m.tf", "azurerm_redis_cache", 2)]


def test_known_systems(spark):
    table = spark.createDataFrame([(2, "postgres", "pg"), (1, "redis", "redis"), (3, "server", "sql"), (0, "mssql", "sql"), (4, "p", "p")], "ord int, prefix string, system string")
    images = [("docker.io/library/postgres:16", "pg"), ("redis:7@sha256:ab", "redis"), ("mcr.microsoft.com/mssql/server", "sql"), ("shop/postgresql-x", "pg"), ("shop/api", None), ("redis.io/other", None), ("portal", "p"), (None, None)]
    got = D.systems_of_images(spark.createDataFrame([(i,) for i, _ in images], "image string"), table).collect()
    assert {r.image: r.system for r in got} == dict(images) and len(got) == len(images)
    types = spark.createDataFrame([("AzureRM_Redis_cache",), ("azurerm_x",)], "type string")
    prefixes = spark.createDataFrame([(1, "azurerm_redis", "redis"), (2, "azurerm_", "azure")], "ord int, prefix string, system string")
    assert {r.type: r.system for r in D.systems_of_resources(types, prefixes).collect()} == {"AzureRM_Redis_cache": "redis", "azurerm_x": "azure"}
    calls = spark.createDataFrame([("Connect", "SmtpClient.Connect"), ("UseNpgsql", None), ("Connect", "Other.Connect"), ("SmtpClient.", "x"), ("Send", "SmtpClient.Send")], "name string, qualified string")
    known = spark.createDataFrame([(1, "SmtpClient.", "mail"), (2, "UseNpgsql", "pg"), (0, "Send", "first")], "ord int, prefix string, system string")
    assert sorted((r.name, r.system or "") for r in D.systems_of_calls(calls, known).collect()) == [("Connect", ""), ("Connect", "mail"), ("Send", "first"), ("SmtpClient.", ""), ("UseNpgsql", "pg")]
