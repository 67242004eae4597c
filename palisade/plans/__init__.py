"""The analytics a user calls: detections, incidents, anomalies, reports."""
