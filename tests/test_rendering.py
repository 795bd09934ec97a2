"""Messages of exported chats with all kinds of blocks."""

import json

from tracemill.sources import transcripts as T


def test_blocks_attachments_and_files(spark, tmp_path):
    long_input, long_result = {"q": "x" * 3000}, "y" * 6000
    blocks = [
        {"type": "text", "text": " hello "}, {"type": "thinking", "thinking": "hm"}, {"type": "thinking", "thinking": ""}, {"type": "token_budget"},
        {"type": "tool_use", "name": "search", "input": {"q": 1}}, {"type": "tool_use", "input": long_input},
        {"type": "tool_result", "name": "search", "is_error": False, "content": [{"type": "text", "text": "a"}, {"type": "text", "text": "b"}]}, {"type": "tool_result", "is_error": True, "content": [{"type": "text", "text": long_result}]},
        {"type": "voice_note", "title": "memo", "text": "said"}, {"type": "voice_note", "text": "bare"}, {"type": "text", "text": "end\n"},
    ]
    messages = [
        {"uuid": "1", "sender": "human", "created_at": "t", "text": "ignored", "content": blocks, "attachments": [{"file_name": "a.txt", "file_type": "txt", "file_size": 12, "extracted_content": "inside"}, {"file_size": None}], "files": [{"file_name": "f.png"}, {}]},
        {"uuid": "2", "sender": "assistant", "created_at": "t", "text": "flat", "content": [{"type": "thinking", "thinking": ""}], "files": []},
        {"uuid": "3", "sender": "assistant", "created_at": "t", "content": None, "attachments": None},
    ]
    (tmp_path / "c.json").write_text(json.dumps([{"uuid": "k", "name": "n", "chat_messages": messages}]))
    got = [r.content for r in T.chat_messages(spark, str(tmp_path / "c.json")).orderBy("seq").collect()]
    cut = (json.dumps(long_input)[:2000] + " ... [truncated]", long_result[:5000] + " ... [truncated]")
    want = "hello \n--- thinking ---\nhm\n\n--- tool_use: search ---\n{\"q\": 1}\n" + f"\n--- tool_use: tool ---\n{cut[0]}\n\n--- tool_result: search (ok) ---\na\nb\n\n--- tool_result: tool (error) ---\n{cut[1]}\n"
    want += "\n--- voice note: memo ---\nsaid\n\n--- voice note ---\nbare\nend\n--- attachment: a.txt (txt, 12B) ---\ninside\n--- attachment: attachment ---\n\n--- file references: f.png, ? ---"
    assert got == [want, "flat", ""]
