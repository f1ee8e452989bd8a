"""Route distances and times from a routing service: a keyed lookup of distinct routes.

Requests run for distinct coordinate pairs alone. Their results are written to the shared folder before the join, so no
retried stage repeats them. The route function is a parameter; the two of this module speak HTTP.
"""

from __future__ import annotations

import base64
import json
import logging
import os
import re
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import checks
from ..scratch import written

log = logging.getLogger(__name__)
#: (start_lon, start_lat, end_lon, end_lat) to (distance in metres, duration in seconds)
RouteFunction = Callable[[float, float, float, float], tuple[float, float]]
GOOGLE = "https://routes.googleapis.com"
_PAIR = re.compile(r"([0-9.]+)s?$")


class _NoRedirect(urllib.request.HTTPRedirectHandler):
    def redirect_request(self, *args, **kwargs):
        return None


def _fetch(request: urllib.request.Request, timeout: float) -> dict:
    with urllib.request.build_opener(_NoRedirect).open(request, timeout=timeout) as reply:
        return json.load(reply)


def checked_server(server: str, authenticated: bool = False) -> str:
    server = checks.label(server, "server").strip().rstrip("/")
    parsed = urllib.parse.urlparse(server)
    if parsed.scheme.lower() not in ("http", "https") or not parsed.hostname:
        raise ValueError("`server` must be a valid HTTP(S) URL.")
    if parsed.username is not None or parsed.password is not None:
        raise ValueError("`server` must not contain URL userinfo; use `username` and `password` instead.")
    if authenticated and parsed.scheme.lower() != "https":
        raise ValueError("HTTPS is required when routing credentials are supplied.")
    return server


def _credentials(username: str | None, password: str | None) -> tuple[str, str] | None:
    if (username is None) != (password is None):
        raise ValueError("`username` and `password` must be supplied together.")
    if username is None:
        return None
    if not isinstance(username, str) or not username.strip() or not isinstance(password, str) or not password:
        raise ValueError("`username` and `password` must be non-empty character values.")
    return username.strip(), password


def _basic(pair: tuple[str, str]) -> str:
    return "Basic " + base64.b64encode(":".join(pair).encode()).decode()


def osrm_request(start_lon: float, start_lat: float, end_lon: float, end_lat: float, *, profile: str = "driving", server: str, username: str | None = None, password: str | None = None) -> urllib.request.Request:
    pair = _credentials(username, password)
    server = checked_server(server, pair is not None)
    number = lambda x: format(x, ".15g")
    where = f"{number(start_lon)},{number(start_lat)};{number(end_lon)},{number(end_lat)}"
    url = f"{server}/route/v1/{urllib.parse.quote(profile, safe='')}/{where}?overview=false&steps=false&alternatives=false"
    return urllib.request.Request(url, headers={"Authorization": _basic(pair)} if pair else {})


def osrm_parse(payload: dict) -> tuple[float, float]:
    if payload.get("code") != "Ok" or not payload.get("routes"):
        raise RuntimeError(f"The routing service did not return a route ({payload.get('code', 'unknown response')}).")
    return float(payload["routes"][0]["distance"]), float(payload["routes"][0]["duration"])


def osrm_route(timeout: float = 60, **how) -> RouteFunction:
    return lambda *at: osrm_parse(_fetch(osrm_request(*at, **how), timeout))


def google_request(start_lon: float, start_lat: float, end_lon: float, end_lat: float, *, travel_mode: str = "DRIVE", routing_preference: str | None = None, server: str = GOOGLE, api_key: str | None = None, username: str | None = None, password: str | None = None) -> urllib.request.Request:
    """A key goes to the public endpoint alone; a proxy gets user and password, over HTTPS."""
    if api_key is not None and server != GOOGLE:
        raise ValueError("Refusing to send routing credentials to an unapproved endpoint.")
    place = lambda lat, lon: {"location": {"latLng": {"latitude": lat, "longitude": lon}}}
    body = {"origin": place(start_lat, start_lon), "destination": place(end_lat, end_lon), "travelMode": travel_mode, "computeAlternativeRoutes": False, "languageCode": "en-US", "units": "METRIC"}
    if travel_mode in ("DRIVE", "TWO_WHEELER"):
        body["routingPreference"] = routing_preference
    headers = {"Content-Type": "application/json", "X-Goog-FieldMask": "routes.distanceMeters,routes.duration"}
    if api_key is not None:
        headers["X-Goog-Api-Key"] = api_key
    else:
        pair = _credentials(username, password)
        if pair is None:
            raise ValueError("Proxy credentials are required.")
        checked_server(server, True)
        headers["Authorization"] = _basic(pair)
    return urllib.request.Request(f"{server.rstrip('/')}/directions/v2:computeRoutes", data=json.dumps(body).encode(), headers=headers, method="POST")


def google_parse(payload: dict) -> tuple[float, float]:
    if not payload.get("routes"):
        raise RuntimeError("The routing service did not return a route.")
    first = payload["routes"][0]
    found = _PAIR.match(str(first.get("duration", "")))
    if not found or not isinstance(first.get("distanceMeters"), (int, float)):
        raise RuntimeError("The routing service returned an invalid distance or duration.")
    return float(first["distanceMeters"]), float(found[1])


def travel(
    df: DataFrame,
    start_latitude: str,
    start_longitude: str,
    end_latitude: str,
    end_longitude: str,
    *,
    route: RouteFunction | None = None,
    profile: str = "driving",
    server: str = "https://router.project-osrm.org",
    username: str | None = None,
    password: str | None = None,
    distance_column: str = "travel_distance",
    time_column: str = "travel_time",
    overwrite: bool = False,
    on_error: str = "warn",
    timeout: float = 60,
    delay: float = 0.1,
    workers: int = 1,
) -> DataFrame:
    """``df`` with the distance and duration of each row's route; null where a coordinate is missing or out of range.

    Each distinct pair of places (to eight decimals) is asked for once. ``workers`` tasks ask at a time, each pausing
    ``delay`` seconds between requests. A failure is null and counted in a warning, or null, or an error, by ``on_error``.
    """
    checks.frame(df)
    names = [start_latitude, start_longitude, end_latitude, end_longitude]
    if any(not isinstance(n, str) or not n for n in names):
        raise ValueError("Coordinate arguments must each be one non-empty column name.")
    unknown = [n for n in names if n not in df.columns]
    if unknown:
        raise ValueError(f"Unknown coordinate columns: {', '.join(unknown)}.")
    checks.label(distance_column, "distance_column")
    checks.label(time_column, "time_column")
    if distance_column == time_column:
        raise ValueError("`distance_column` and `time_column` must be different.")
    checks.flag(overwrite, "overwrite")
    clash = [c for c in (distance_column, time_column) if c in df.columns]
    if clash and not overwrite:
        raise ValueError(f"Output columns already exist: {', '.join(clash)}. Use `overwrite=True` to replace them.")
    checks.choice(on_error, "on_error", ("warn", "stop", "na"))
    if not timeout > 0:
        raise ValueError("`timeout` must be positive.")
    if not delay >= 0:
        raise ValueError("`delay` must be non-negative.")
    if route is None:
        osrm_request(0, 0, 0, 0, profile=profile, server=server, username=username, password=password)
        route = osrm_route(timeout, profile=profile, server=server, username=username, password=password)
    ask = route
    key, parts = "__route", [f"__c{i}" for i in range(4)]
    coords = [checks.q(n).cast("string").try_cast("double") for n in names]
    inside = [F.coalesce(F.abs(c) <= most, F.lit(False)) & ~F.isnan(c) for c, most in zip(coords, (90, 180, 90, 180))]
    valid = inside[0] & inside[1] & inside[2] & inside[3]
    text = F.concat_ws("|", *[F.call_function("format_number", c, F.lit("0.00000000")) for c in coords])
    keyed = df.select(*[checks.q(c) for c in df.columns if c not in clash], F.when(valid, text).alias(key), *[c.alias(p) for c, p in zip(coords, parts)])

    def requests(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fresh = True
        for pdf in frames:
            rows = []
            for k, la0, lo0, la1, lo1 in pdf.itertuples(index=False):
                if delay and not fresh:
                    time.sleep(delay)
                fresh = False
                try:
                    distance, duration = ask(lo0, la0, lo1, la1)
                    rows.append((k, float(distance), float(duration), None))
                except Exception as e:  # any failure of the service
                    if on_error == "stop":
                        raise
                    rows.append((k, None, None, str(e)))
            yield pd.DataFrame(rows, columns=[key, "__distance", "__time", "__error"])

    unique = keyed.filter(F.col(key).isNotNull()).groupBy(key).agg(*[F.first(p).alias(p) for p in parts])
    found = written(unique.repartition(checks.whole(workers, "workers", 1)).mapInPandas(requests, f"{key} string, __distance double, __time double, __error string"), "routes")
    if on_error == "warn":
        s = found.filter("__error is not null").agg(F.count(F.lit(1)).alias("n"), F.min("__error").alias("e")).first()
        if s["n"]:
            log.warning("%d route request(s) failed; results were set to null. First failure: %s", s["n"], s["e"])
    out = keyed.join(found.drop("__error"), key, "left")
    kept = [checks.q(c) for c in df.columns if c not in clash]
    return out.select(*kept, F.col("__distance").alias(distance_column), F.col("__time").alias(time_column))


def google_travel(
    df: DataFrame,
    start_latitude: str,
    start_longitude: str,
    end_latitude: str,
    end_longitude: str,
    *,
    backend: str = "google",
    proxy: str | None = None,
    api_key: str | None = None,
    username: str | None = None,
    password: str | None = None,
    travel_mode: str = "DRIVE",
    routing_preference: str | None = None,
    timeout: float = 60,
    **how,
) -> DataFrame:
    """``travel`` by the Google Routes service, with a key (or GOOGLE_MAPS_API_KEY), or by a proxy of it with credentials."""
    checks.choice(backend, "backend", ("google", "proxy"))
    mode = checks.choice(str(travel_mode).strip().upper(), "travel_mode", ("DRIVE", "WALK", "BICYCLE", "TWO_WHEELER", "TRANSIT"))
    if mode in ("DRIVE", "TWO_WHEELER"):
        routing_preference = checks.choice(str(routing_preference or "TRAFFIC_UNAWARE").strip().upper(), "routing_preference", ("TRAFFIC_UNAWARE", "TRAFFIC_AWARE", "TRAFFIC_AWARE_OPTIMAL"))
    elif routing_preference is not None:
        log.warning("`routing_preference` is ignored unless `travel_mode` is DRIVE or TWO_WHEELER.")
        routing_preference = None
    if backend == "google":
        if username is not None or password is not None:
            raise ValueError("`username` and `password` are only used with the proxy.")
        api_key = api_key if api_key is not None else os.environ.get("GOOGLE_MAPS_API_KEY")
        if not api_key or not api_key.strip():
            raise ValueError("A Google Routes API key is required. Set `GOOGLE_MAPS_API_KEY` or supply `api_key`.")
        where = {"server": GOOGLE, "api_key": api_key.strip()}
    else:
        if proxy is None or _credentials(username, password) is None:
            raise ValueError("Proxy credentials are required. Supply `proxy`, `username` and `password`.")
        where = {"server": checked_server(proxy, True), "username": username, "password": password}
    google_request(0, 0, 0, 0, travel_mode=mode, routing_preference=routing_preference, **where)
    ask = lambda *at: google_parse(_fetch(google_request(*at, travel_mode=mode, routing_preference=routing_preference, **where), timeout))
    route = how.pop("route", None) or ask
    return travel(df, start_latitude, start_longitude, end_latitude, end_longitude, route=route, timeout=timeout, **how)
