"""Siderite streaming."""
