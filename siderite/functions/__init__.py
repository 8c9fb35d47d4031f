"""Siderite functions."""
