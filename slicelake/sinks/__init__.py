"""Writers: the slice lake, imports, exports, audit logs."""
