"""Shipment-delay analytics as Spark jobs."""
