"""A stand-in for a remote source: pages made of what was asked."""

import json


def pages(request_id, query_no, page_no, from_time, to_time):
    """Three pages a query; request ``down`` fails, query 3 raises on its second page."""
    if query_no == 3 and page_no == 2:
        raise TimeoutError
    start = from_time.strftime("%Y-%m-%dT20:00:00Z") if from_time else "2024-01-16T20:00:00Z"
    venue = {"name": "Hall", "latitude": "26.3", "longitude": "-80.1", "address": {"address_1": "1 Main St"}}
    events = [{"id": f"{page_no if page_no < 3 else 1}-{query_no // 2}-{n}", "name": {"text": f"Show {query_no}-{page_no}-{n}"}, "start": {"utc": start}, "venue": venue} for n in range(2 if page_no < 4 else 0)]
    return request_id != "down", json.dumps({"events": events, "pagination": {"has_more_items": page_no < 3}})
