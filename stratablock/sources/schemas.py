"""Schemas of the tables and messages of the store."""

#: Fields and their order.
LAYERS = "file_id string, parent_id string, device_id string, node_id string, size long, block_size int, cluster_size int, hash_size int, ts long, is_root boolean, is_partial boolean, has_blocks boolean, writable boolean, version long"
BLOCK_MAP = "file_id string, block_index long, version long, state tinyint, key binary"
BLOCKS = "key binary, data binary, generation long, refcnt long, ibp int, tier string"
ITEMS = "uuid string, kind string, vvr string, file_id string, name string, description string, deleted boolean, active string, props map<string,string>"
JOURNAL = "resource string, seq long, tx_id long, op string, task_id string, ts long, nodes array<string>, payload binary, err int"
IO_OPS = "seq long, device_id string, op string, offset long, length long, data binary, ts timestamp"
REPLICAS = "node_id string, file_id string, version long, writable boolean"
CLUSTERS = "node_id string, file_id string, cluster_index long, hash binary"
TASKS = "task_id string, tx_id long, resource string, status string, name string, description string, ts long"
BLOCK_CHANGES = "source string, key binary, data binary, old_key binary, message array<binary>"
FILE_UPDATES = "file_id string, updates array<struct<block_index: long, version: long, state: tinyint, key: binary, data: binary>>, eof boolean"

ALL = {"layers": LAYERS, "block_map": BLOCK_MAP, "blocks": BLOCKS, "items": ITEMS, "journal": JOURNAL, "io_ops": IO_OPS, "replicas": REPLICAS, "clusters": CLUSTERS, "tasks": TASKS, "block_changes": BLOCK_CHANGES, "file_updates": FILE_UPDATES}
