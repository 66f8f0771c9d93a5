"""Binary layouts of payloads, regions, textures and scenes, and the text of manifests."""
